"""Operator 7: shards of near equal bytes by sampled splitters."""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewire.llm.common import stored

#: Ranges for each shard, and sampled keys for each range: boundaries stay a bounded list, whatever the input.
RANGES, SAMPLE = 64, 16
#: A range is overfull beyond so many times its due: a sixteenth of a shard. Smaller groups of equal texts stay whole.
OVERFULL = 4
#: Bytes of a row besides its text.
ROW_BYTES = 8


def assign(docs: DataFrame, shards: int = 24, ranges: int = RANGES, sample: int = SAMPLE, label: str = "sharding") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, range, part): near equal bytes (law `bytes`), slots gapless from 0 in each shard.

    1. The key is a hash of the text, so that equal texts stay together. Keys are sampled by size (a key's chance grows with its bytes), about shards x ranges x sample of them,
    and their quantiles are the boundaries of shards x ranges ranges of about equal bytes. 2. The bytes of each range are counted exactly. An overfull range (more than OVERFULL times its due: a
    large group of copies) is subdivided by a hash of the id. 3. Ranges and parts go, by falling size, each to the shard with the fewest bytes so far. 4. Slots are
    ranks within a part, offset by the rows of the shard's earlier parts, so that no task orders a whole shard.

    A null text has no bytes besides the row's, and the crc of an empty one. Null ids are allowed; rows that are equal in all take any order.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")), label)
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    # exponential waiting times: those below a bound are a sample in which a row's chance is proportional to its size, of about the number wanted
    draw = (F.pmod(F.xxhash64("doc_id", "key", F.lit(1)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    drawn = keyed.where(-F.log(draw) / F.col("size") <= shards * ranges * sample / max(1, total)).select("key")
    keys = sorted(r["key"] for r in drawn.collect())
    cuts = sorted({keys[k * len(keys) // (shards * ranges)] for k in range(1, shards * ranges)}) if keys else []
    number = _range_of(keyed, cuts)
    due = max(1, -(-total // (shards * ranges)))
    sizes = number.groupBy("range").agg(F.sum("size").alias("bytes")).collect()  # shards x ranges rows at most
    parts = {r["range"]: -(-r["bytes"] // due) for r in sizes if r["bytes"] > OVERFULL * due}
    split = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]) if parts else F.lit(None).cast("map<int,bigint>")
    dealt = number.withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.try_element_at(split, F.col("range")).cast("long")), F.lit(0)).cast("int"))
    counts = sorted(dealt.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect(), key=lambda r: (-r["bytes"], r["range"], r["part"]))
    heap = [(0, s) for s in range(shards)]
    rows = [0] * shards
    placed = []
    for r in counts:
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + r["bytes"], s))
        placed.append((r["range"], r["part"], s, rows[s]))
        rows[s] += r["rows"]
    spark = docs.sparkSession
    where = F.broadcast(spark.createDataFrame(placed, "range int, part int, shard int, _before long"))  # three times shards x ranges rows at most
    slot = F.row_number().over(Window.partitionBy("range", "part").orderBy("key", "doc_id")) - 1
    ranked = dealt.withColumn("_slot", slot).join(where, ["range", "part"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_slot")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "range", "part")


def _range_of(keyed: DataFrame, cuts: list[int]) -> DataFrame:
    """``keyed`` with the number of the range of each key: how many boundaries are not above it.

    The boundaries become a map from the keys' leading bits to those that begin there, so that a row compares itself with a few of them only.
    """
    bits = 10
    first = lambda c: (c >> (64 - bits)) + (1 << (bits - 1))
    buckets: list[list[int]] = [[] for _ in range(1 << bits)]
    for c in cuts:
        buckets[first(c)].append(c)
    bases = [bisect.bisect_left(cuts, (k - (1 << (bits - 1))) << (64 - bits)) for k in range(1 << bits)]
    lead = F.shiftright("key", 64 - bits) + (1 << (bits - 1))
    spark = keyed.sparkSession
    table = F.broadcast(spark.createDataFrame([(k, bases[k], buckets[k]) for k in range(1 << bits)], "_lead long, _base int, _cuts array<bigint>"))
    joined = keyed.withColumn("_lead", lead.cast("long")).join(table, "_lead")
    return joined.select("doc_id", "size", "text_crc32", "key", (F.col("_base") + F.size(F.filter("_cuts", lambda c: c <= F.col("key")))).cast("int").alias("range"))
