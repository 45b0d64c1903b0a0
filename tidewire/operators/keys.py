"""First, last and best rows per key, written so that a dominant key never lands whole in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.core import epoch_seconds, seconds_between

_RANK = "__rank"


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key.

    Spark pushes a rank filter below the shuffle (window group limit), so each map task sends at most ``n`` rows per
    key. For n above ``spark.sql.optimizer.windowGroupLimitThreshold`` the result is the same without that saving.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(_RANK, rank).where(F.col(_RANK) <= n).drop(_RANK)


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the earliest in input order."""
    return top_per(df, keys, [F.asc(order)], 1)


def gaps_between_times(df: DataFrame, key: str, ts: str, tie: str, chunk_seconds: int = 60, chunks: int = 1440) -> DataFrame:
    """One row per key and distinct time: ``n`` rows at that time, the smallest ``tie`` and the gap to the time before.

    Equal times are merged by a partial aggregation first. The distinct times are then ordered inside (key, time chunk); the first of a chunk takes the end of the chunk before, which is carried
    in two levels: inside a span of ``chunks`` chunks (a day), and from span to span. So neither a key nor an instant that holds a third of all rows meets in one task: a chunk holds at most
    its microseconds, a span its chunks, and a key the days of its history.
    """
    times = df.groupBy(key, ts).agg(F.count("*").alias("n"), F.min(tie).alias("first_tie"))
    chunk = F.floor(epoch_seconds(ts) / F.lit(chunk_seconds)).cast("long")
    chunked = times.withColumn("__chunk", chunk)
    inner = F.lag(ts).over(W.partitionBy(key, "__chunk").orderBy(ts))
    ends = chunked.groupBy(key, "__chunk").agg(F.max(ts).alias("__end")).withColumn("__span", F.floor(F.col("__chunk") / chunks))
    in_span = ends.withColumn("__last", F.lag("__end").over(W.partitionBy(key, "__span").orderBy("__chunk")))
    spans = ends.groupBy(key, "__span").agg(F.max("__end").alias("__end"))
    from_span = spans.select(F.col(key).alias("__of"), F.col("__span").alias("__s"), F.lag("__end").over(W.partitionBy(key).orderBy("__span")).alias("__far"))
    carried = in_span.join(from_span, F.col(key).eqNullSafe(F.col("__of")) & (F.col("__span") == F.col("__s")), "left").select(
        F.col(key).alias("__key"), F.col("__chunk").alias("__c"), F.coalesce("__last", "__far").alias("__carried")
    )
    joined = chunked.withColumn("__before", inner).join(
        carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__chunk") == F.col("__c")), "left"
    )
    gap = seconds_between(F.coalesce("__before", "__carried"), F.col(ts))
    return joined.select(key, ts, "n", "first_tie", gap.alias("gap_seconds"))


def gap_to_previous(df: DataFrame, key: str, ts: str, tie: str, chunk_seconds: int = 60) -> DataFrame:
    """Add ``gap_seconds`` to the previous row of the same key by (time, tie); null for the first row of a key.

    All but the first row of an instant follow at gap zero. The join back is an equality join whose large side adaptive
    execution can split.
    """
    gaps = gaps_between_times(df, key, ts, tie, chunk_seconds).select(
        F.col(key).alias("__key"), F.col(ts).alias("__ts"), "first_tie", F.col("gap_seconds").alias("__gap")
    )
    joined = df.join(gaps, F.col(key).eqNullSafe(F.col("__key")) & (F.col(ts) == F.col("__ts")), "left")
    gap = F.when(F.col(tie) == F.col("first_tie"), F.col("__gap")).otherwise(F.lit(0.0))
    return joined.withColumn("gap_seconds", gap).drop("__key", "__ts", "first_tie", "__gap")
