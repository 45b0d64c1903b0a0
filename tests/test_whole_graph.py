"""The queries on the graph of all pairs have every pair that two documents share."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewire.operators import pair_tiles, sinks, terms

QUERIES = entry.queries()


def test_entry_has_thirty_edges(spark):
    assert entry.entry(spark).count() == 30


def test_pairs_of_two_documents_are_edges(spark, sf):
    rows = {r["pairs"]: r["edges"] for r in QUERIES["A2_cooccurrence"](spark, sf).collect()}
    assert min(rows) == 2 and sum(rows.values()) == 1_480_488


def test_block_pairs_have_every_pair_once_and_spread_a_long_document(spark):
    long, short = sorted(f"t{k:05d}" for k in range(3000)), ["a", "b", "c"]
    sets = spark.createDataFrame([(1, long), (2, short), (5, ["alone"]), (3, long[:128]), (4, long[:129])], "n long, terms array<string>")
    dealt = terms.block_pairs(sets)
    assert dealt.agg(F.max(F.greatest(F.size("left"), F.size("right")))).first()[0] <= terms.BLOCK_TERMS
    big = dealt.where("n = 1").groupBy(F.spark_partition_id()).count().collect()
    assert len(big) > 1 and sum(r["count"] for r in big) == 24 * 25 // 2  # blocks of 128, each with itself and those after it
    want = Counter()
    for n, t in sets.collect():
        want.update({p: n for p in combinations(t, 2)} if n != 1 else {})
    got = {(r["src"], r["dst"]): r["weight"] for r in terms._pair_counts(sets.where("n <> 1").select(F.explode(F.array_repeat("terms", F.col("n").cast("int"))).alias("terms")), 1).collect()}
    assert got == dict(want)
    assert terms._pair_counts(sets.where("n = 1").select("terms"), 1).count() == 3000 * 2999 // 2


def test_no_term_set_is_copied_into_the_rows_of_its_terms(spark):
    plan = terms._pair_counts(spark.createDataFrame([(["a", "b"],)], "terms array<string>"), 1)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"explode\(slice\(terms", plan) and "inline" in plan


def test_tiles_hold_every_pair_once(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"{rng.choice('aäz한')}{k}" for k in range(90)]
    docs = [(i, rng.choices(words, [1 / (k + 1) for k in range(90)], k=rng.randrange(0, 60))) for i in range(120)]
    docs += [(1000 + i, words[:40]) for i in range(50)] + [(2000, None), (2001, ["a0"]), (2002, words)]
    tokens = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    want, held = Counter(), Counter()
    for _, t in docs:
        held.update(set(t or ()))
        want.update(combinations(sorted(set(t or ()), key=str.encode), 2))
    for tile, least in ((8_000_000, 2), (3000, 1), (3000, 2)):
        monkeypatch.setattr(pair_tiles, "TILE_PAIRS", tile)
        got = [tuple(r) for r in terms.cooccurrence_with_ends(tokens, least).collect()]
        assert sorted(got) == sorted((a, b, n, held[a], held[b]) for (a, b), n in want.items() if n >= least)
    assert terms.cooccurrence(tokens.limit(0)).count() == 0


def test_chunks_of_a_tile_sum_up(monkeypatch):
    monkeypatch.setattr(pair_tiles, "CHUNK", 10)
    rng = random.Random(4)
    sets = [(sorted(rng.sample(range(30), rng.randrange(1, 20))), rng.choice((1, 1, 3))) for _ in range(40)]
    side = tuple(np.array(x) for x in zip(*[(d, n, i) for d, (ids, n) in enumerate(sets) for i in ids], strict=True))
    sums, want = pair_tiles._Sums(), Counter()
    for keys, weights in pair_tiles._pairs(side, side, True):
        assert len(keys) <= 30
        sums.add(keys, weights)
    for ids, n in sets:
        want.update({p: n for p in combinations(ids, 2)})
    keys, weights = sums.total()
    assert {(int(k >> 32), int(k & 0xFFFFFFFF)): int(w) for k, w in zip(keys, weights, strict=True)} == dict(want)


def test_blocks_take_few_bytes_a_term(spark):
    """What is dealt to the tiles: a number below 65,536 takes little more than two bytes, and copies none where there are none."""
    rng = random.Random(1)
    sets = [(sorted((k % 4 << 32) + k // 4 for k in rng.sample(range(80_000), 300)), 1, 0) for _ in range(200)]
    rows = spark.createDataFrame(sets, "codes array<long>, n long, period int").coalesce(1).mapInArrow(pair_tiles._blocks, pair_tiles._BLOCK).collect()
    assert sorted(r["part"] for r in rows) == [0, 1, 2, 3]
    packed = sum(len(pa.compress(bytes(v), "lz4_raw", asbytes=True)) for r in rows for v in r if isinstance(v, (bytes, bytearray)) and v)
    assert packed < 2.5 * 200 * 300


def test_a_row_beyond_a_chunk_is_summed_in_pieces(monkeypatch):
    rng = random.Random(5)
    sets = [(sorted(rng.sample(range(40), rng.randrange(1, 30))), rng.choice((1, 1, 4))) for _ in range(60)]
    side = tuple(np.array(x) for x in zip(*[(d, n, i) for d, (ids, n) in enumerate(sets) for i in ids], strict=True))
    other = side[0], side[1], side[2].astype(np.int32) * 5
    want = sum((Counter({(a, 5 * b): n for a in ids for b in ids}) for ids, n in sets), Counter())
    for chunk, cells in ((7, 4), (300, 4), (300, 0), (10_000_000, 4), (10_000_000, 0)):
        monkeypatch.setattr(pair_tiles, "CHUNK", chunk)
        monkeypatch.setattr(pair_tiles, "CELLS", cells)
        got = [(int(k >> 32), int(k & 0xFFFFFFFF), int(w)) for keys, weights in pair_tiles._pairs(side, other, False) for k, w in zip(keys, weights, strict=True)]
        assert got == sorted((a, b, n) for (a, b), n in want.items())


def test_edges_of_two_periods_meet_in_their_tile(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"{rng.choice('aäz한')}{k}" for k in range(400)]
    docs = [(i, rng.choices(words, k=rng.randrange(0, 60))) for i in range(60) if i not in (5, 7)] + [(60, None), (61, words[:90]), (62, words[60:]), (5, words[30:90]), (7, words[20:80])]
    tokens = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    old, new = tokens.where("doc_id < 30 or doc_id = 61"), tokens.where("doc_id >= 20")
    monkeypatch.setattr(pair_tiles, "TILE_PAIRS", 2000)
    both = terms.cooccurrence_of_both(old, new)
    dated = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at")
    joined = sinks.merge_edges(terms.cooccurrence(old).select("*", dated), terms.cooccurrence(new), "2024-01-02 00:00:00")
    beside = sinks.merge_edges(both.select("*", dated), None, "2024-01-02 00:00:00")
    assert sorted(map(tuple, beside.collect())) == sorted(map(tuple, joined.collect())) and joined.select("updated_at").distinct().count() == 2
    plan = beside._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert "Join" not in plan and "Exchange" not in plan  # nothing is moved once the edges are formed
    shape = lambda e, p="": e.select("src", "dst", F.col(f"{p}weight").cast("double").alias("weight"), F.col(f"{p}weight").alias("co_count"))
    joined = sinks.merge_edges_ema(shape(terms.cooccurrence(old)), shape(terms.cooccurrence(new)))
    beside = sinks.merge_edges_ema(both.select("src", "dst", F.col("weight").cast("double").alias("weight"), F.col("weight").alias("co_count"), F.col("batch_weight").cast("double").alias("batch_weight"), F.col("batch_weight").alias("batch_co_count")), None)
    assert sorted(map(tuple, beside.collect())) == sorted(map(tuple, joined.collect()))
    assert terms.cooccurrence_of_both(old.limit(0), new.limit(0)).count() == 0
