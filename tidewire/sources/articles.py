"""Article scans: the recent window and the range-partitioned archive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.core import LOCAL_OFFSET_HOURS, local_time, ts_literal


def recent_articles(articles: DataFrame, as_of, lookback_hours: int = 2, n: int = 500) -> DataFrame:
    """The newest ``n`` articles crawled within the lookback."""
    start = ts_literal(as_of) - F.make_dt_interval(hours=F.lit(lookback_hours))
    return (
        articles.where(F.col("crawled_at") >= start)
        .orderBy(F.desc("published_at"), F.desc("id"))
        .limit(n)
        .select("id", "source_id", "title", "content", "published_at")
    )


def with_pub_year(articles: DataFrame) -> DataFrame:
    """The partition column: year of publication on the local clock."""
    return articles.withColumn("pub_year", F.year(local_time("published_at")))


def write_articles(articles: DataFrame, path: str, mode: str = "append") -> None:
    """Archive layout: one folder per local year, sorted by time inside a file so that row-group statistics prune."""
    with_pub_year(articles).sortWithinPartitions("pub_year", "published_at").write.mode(mode).partitionBy("pub_year").parquet(path)


def read_articles(spark: SparkSession, path: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Articles published in [start, end); only the years in range are listed and read."""
    shift = dt.timedelta(hours=LOCAL_OFFSET_HOURS)
    years = F.col("pub_year").between((start + shift).year, (end + shift).year)
    return (
        spark.read.parquet(path)
        .where(years & (F.col("published_at") >= ts_literal(start)) & (F.col("published_at") < ts_literal(end)))
        .drop("pub_year")
    )


def archive_calendar(days: DataFrame, section_code: str, pages: int = 5) -> DataFrame:
    """Backfill work list: one row per day and page.

    ``days`` has one row per range with the columns ``start`` and ``end`` (dates). Both ends are included.
    """
    return (
        days.select(F.explode(F.sequence("start", "end", F.make_dt_interval(days=F.lit(1)))).alias("day"))
        .distinct()
        .select("day", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page"))
        .select(
            "day",
            "page",
            F.concat(
                F.lit(f"mode=LSD&mid=sec&sid1={section_code}&date="), F.date_format("day", "yyyyMMdd"), F.lit("&page="), F.col("page").cast("string")
            ).alias("query"),
        )
    )


# Archive section codes.
SECTIONS = {"economy": "101", "tech": "105", "society": "102", "politics": "100", "world": "104"}


def stock_snapshot(bars: DataFrame, day) -> DataFrame:
    """All codes of one day."""
    return bars.where(F.col("target_dt") == F.lit(day).cast("date"))


def price_history(bars: DataFrame, code: str, start) -> DataFrame:
    """The bars of one code from a day on."""
    return bars.where((F.col("code") == code) & (F.col("target_dt") >= F.lit(start).cast("date")))
