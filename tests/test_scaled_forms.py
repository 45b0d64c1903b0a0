"""Forms made for long histories, long lists and hot keys, against plain ones."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.operators import articles as ar
from tidewire.operators import keys, terms
from tidewire.streaming import operators as st

T0 = dt.datetime(2016, 1, 1)


def test_gaps_carry_over_chunks_spans_and_years(spark):
    rng = random.Random(1)
    times = [(k, rng.choice(("a", "b", None)), T0 + dt.timedelta(seconds=rng.choice((rng.random() * 90, rng.randrange(86_400 * 3650), k)))) for k in range(3000)]
    rows = spark.createDataFrame(times, "id long, key string, ts timestamp_ntz").repartition(4)
    plain = F.lag("ts").over(Window.partitionBy("key").orderBy("ts", "id"))
    want = rows.withColumn("before", plain).select("id", ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))) / 1e6).alias("g"))
    for more in ({}, {"chunk_seconds": 5, "chunks": 7}):
        got = keys.gap_to_previous(rows, "key", "ts", "id", **more) if more.get("chunks") is None else None
        gaps = keys.gaps_between_times(rows, "key", "ts", "id", **more)
        firsts = rows.groupBy("key", "ts").agg(F.min("id").alias("id"))
        by_time = {(r["key"], r["ts"]): r["gap_seconds"] for r in gaps.collect()}
        expected = {r["id"]: r["g"] for r in want.collect()}
        assert all(by_time[r["key"], r["ts"]] == expected[r["id"]] for r in firsts.collect())
        if got is not None:
            assert {r["id"]: r["gap_seconds"] for r in got.collect()} == expected


def test_no_window_grows_with_the_years(spark):
    """A call a minute for ten years: the longest window is that of a day's chunks or of the days."""
    rows = spark.range(5_256_000).select("id", F.lit("d").alias("key"), F.timestamp_add("MINUTE", F.col("id").cast("int"), F.lit(T0)).cast("timestamp_ntz").alias("ts"))
    gaps = keys.gaps_between_times(rows, "key", "ts", "id")
    one = gaps.agg(F.count("*"), F.min("gap_seconds"), F.max("gap_seconds"), F.count_if(F.col("gap_seconds").isNull())).first()
    assert tuple(one) == (5_256_000, 60.0, 60.0, 1)
    plan = gaps._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [lag") == 3 and "__span" in plan


def greedy(rows, n):
    taken = []
    for r in sorted(rows, key=lambda r: (r[4], r[0]), reverse=True):
        if len(taken) < n and not any(t[2] == r[2] or (t[3] or "") == (r[3] or "") for t in taken):
            taken.append(r)
    return [r[0] for r in taken]


@pytest.mark.parametrize("seed", range(4))
def test_the_queue_is_the_greedy_one(spark, seed):
    rng = random.Random(seed)
    urls, titles = rng.choice(((3, 300), (300, 3), (12, 12), (400, 400)))
    rows = [(k, 1, rng.choice([f"u{rng.randrange(urls)}", None] if seed == 2 else [f"u{rng.randrange(urls)}"]), rng.choice([f"t{rng.randrange(titles)}", None, ""]), T0 + dt.timedelta(seconds=rng.randrange(200))) for k in range(500)]
    rows += [(1000 + k, 1, "hot", "hot", T0 + dt.timedelta(days=1, seconds=k)) for k in range(300)]  # copies at the head
    df = spark.createDataFrame(rows, "id long, source_id int, url string, title string, published_at timestamp_ntz").withColumns({"summary": F.lit(None).cast("string"), "metadata": F.lit("{}")})
    for n in (1, 4, 8):
        assert [r["id"] for r in ar.pending_text(df, n).collect()] == greedy(rows, n)


def test_the_queue_runs_no_job_until_it_is_asked(spark):
    df = spark.createDataFrame([(1, 1, "u", "t", T0, None, "{}")], "id long, source_id int, url string, title string, published_at timestamp_ntz, summary string, metadata string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("queue", "")
    found = ar.pending_text(df)
    assert not tracker.getJobIdsForGroup("queue")
    assert found.count() == 1 and tracker.getJobIdsForGroup("queue")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_many_terms_are_found_wherever_they_stand(spark):
    rng = random.Random(3)
    letters = "abcdé한0"
    wanted = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(10_000)} | {"Abc", "ABC"})
    texts = [("".join(rng.choice(letters + letters.upper() + " .-") for _ in range(rng.randint(0, 300))), rng.choice(("Abc", None, ""))) for _ in range(60)] + [(None, None), ("", "")]
    docs = spark.createDataFrame([(k, t, s) for k, (t, s) in enumerate(texts)], "id long, title string, summary string")
    found = terms.term_match(docs, spark.createDataFrame([(w,) for w in wanted], "term string"), "none")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Contains" not in plan
    for r in found.collect():
        title, summary = texts[r["id"]]
        low = f"{title or ''} {summary or ''}".lower()
        assert r["matched_terms"] == (sorted(w for w in wanted if w.lower() in low) or ["none"])
    assert [r["matched_terms"] for r in terms.term_match(docs.limit(1), spark.createDataFrame([], "term string"), "c").collect()] == [["c"]]


def test_term_match_shuffles_runs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(terms, "MATCH_DOCS", 7)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcé1") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(12))) for _ in range(60)]
    wanted = sorted({"".join(rng.choice("abcÉ1") for _ in range(rng.randrange(1, 4))) for _ in range(60)})
    docs = spark.createDataFrame([*enumerate(texts), (60, None)], "id long, title string").withColumn("summary", F.lit(None).cast("string"))
    found = terms.term_match(docs, spark.createDataFrame([(w,) for w in wanted], "term string"), "none")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in text and "collect_set" not in text  # no row for each document and term
    got = {r["id"]: r["matched_terms"] for r in found.collect()}
    assert got == {i: sorted(w for w in wanted if w.lower() in t.lower()) or ["none"] for i, t in [*enumerate(texts), (60, "")]}


def test_windows_of_panes_are_those_of_the_rows(spark):
    rng = random.Random(7)
    rows = spark.createDataFrame([(rng.choice("abc"), T0 + dt.timedelta(seconds=rng.randrange(20_000))) for _ in range(800)], "term string, created_at timestamp_ntz")
    panes = st.mention_panes(rows)
    assert "Expand" not in panes._jdf.queryExecution().optimizedPlan().toString()  # a row goes to one pane
    got = {(r["start"], r["term"]): r["mentions"] for r in st.windows_of(panes).collect()}
    plain = rows.withColumn("created_at", F.col("created_at").cast("timestamp")).groupBy(F.window("created_at", "1 hour", "5 minutes").alias("w"), "term").agg(F.count("*").alias("n"))
    assert got == {(r["w"]["start"], r["term"]): r["n"] for r in plain.collect()}


def test_coarse_sums_come_from_fine_ones(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([(rng.choice("ab"), T0 + dt.timedelta(minutes=rng.randrange(9000)), rng.randrange(9)) for _ in range(500)], "term string, time timestamp_ntz, frequency long")
    found = terms.term_rollups(rows)
    for minutes in terms.GRAINS:
        want = sorted(tuple(r) for r in terms.term_rollup(rows, minutes).collect())
        assert sorted(tuple(r) for r in found.where(F.col("minutes") == minutes).drop("minutes").collect()) == want
    with pytest.raises(ValueError):
        terms.term_rollups(rows, (10, 25))


def test_rollups_shuffle_once_and_compare_over_the_ends_of_chunks(spark):
    rng = random.Random(9)
    tokens = [(T0 + dt.timedelta(minutes=rng.randrange(60)), T0 + dt.timedelta(minutes=7 * rng.randrange(60_000)), rng.choices(["a", "b", "c", "é"], k=rng.randrange(6))) for _ in range(1500)]
    tokens += [(T0, T0 + dt.timedelta(minutes=minute), ["z"]) for minute in range(0, 1440 * 300, 1440)] + [(T0, T0, []), (T0, T0, None), (T0, None, ["a"]), (T0, T0, ["b", None, "b", None, "a"])]
    counts = terms.counts_in_text(spark.createDataFrame(tokens, "x timestamp_ntz, time timestamp_ntz, tokens array<string>"), "time")
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    found = terms.term_rollups(counts)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    for minutes in terms.GRAINS:
        want = {}
        for _, time, words in tokens:
            for word in words or []:
                if word and time:
                    key = (word, T0 + (time - T0) // dt.timedelta(minutes=minutes) * dt.timedelta(minutes=minutes))
                    want[key] = want.get(key, 0) + 1
        got = {(r["term"], r["bucket"]): (r["frequency"], r["previous"], r["change"]) for r in found.where(F.col("minutes") == minutes).collect()}
        before = {k: want.get((k[0], k[1] - dt.timedelta(minutes=minutes)), 0) for k in want}
        assert got == {k: (n, before[k], n - before[k]) for k, n in want.items()}


def test_graph_queries_without_the_whole_graph(spark):
    rng = random.Random(7)
    words = [f"w{i:02d}" for i in range(60)]
    docs = [(i, sorted(set(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randrange(2, 25)))) * 2) for i in range(150)]
    tokens = spark.createDataFrame(docs + [(999, []), (1000, None)], "doc_id long, tokens array<string>")
    edges = terms.cooccurrence(tokens).cache()
    rows = lambda df: sorted(map(tuple, df.collect()))
    for word in ("w00", "w31", "none"):
        assert rows(terms.neighbors_of(tokens, word, 12)) == rows(terms.neighbors(edges, word, 12))
        assert rows(terms.topic_expand_of(tokens, word, 4, 3)) == rows(terms.topic_expand(edges, word, 4, 3))
    for n in (1, 30, 5000):  # with fewer edges than asked for, too
        assert terms.top_edges_of(tokens, n).collect() == terms.top_edges(edges, n).collect()
    assert terms.nth_weight(edges, 3) == terms.top_edges(edges, 3).collect()[-1]["weight"] and terms.nth_weight(edges, 10**6) == 2
