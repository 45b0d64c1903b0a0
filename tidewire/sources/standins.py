"""Adapters that shape the driver's Parquet tables like the tables the operators expect.

Every adapter is a projection (or one aggregation) of a whole table, so the work of a query grows with its input.
``tidewire.plans.views`` holds the same shapes as SQL for the value checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.core import from_epoch, json_text
from tidewire.sources.files import read_table

# Fixed values of the test set-up: "now" for articles, events and the market.
ARTICLES_AS_OF = "2026-01-02 12:00:00"
EVENTS_AS_OF = "2024-01-30 12:00:00"
MARKET_AS_OF = "2001-06-01"
ARTICLES_START_EPOCH = 1767139200  # 2025-12-31 00:00:00
EVENT_TYPES = {"view": "seed_scan", "click": "article_ingest", "purchase": "image_ingest", "signup": "llm_enrich", "error": "error"}


# Tables of long texts, where the work per row is large.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def _choose(key, *values):
    """One of the values by an integer key 0, 1, 2, …; the last value is the default."""
    out = None
    for i, v in enumerate(values[:-1]):
        v = v if not isinstance(v, str | None) else F.lit(v)
        out = F.when(key == i, v) if out is None else out.when(key == i, v)
    last = values[-1]
    return out.otherwise(last if not isinstance(last, str | None) else F.lit(last))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    key = doc.cast("string")
    published = from_epoch(F.lit(ARTICLES_START_EPOCH) + doc * 420)
    tail = _choose(doc % 4, F.concat(F.lit("?utm_source=x&id="), key), "/", "#top", "")
    meta = _choose(
        doc % 5,
        None,
        "{}",
        F.concat(
            F.lit('{"nlp_processed":true,"vision_processed":true,"images":["https://img.example.com/a'), key, F.lit('.png"]}')
        ),
        F.concat(
            F.lit('{"nlp_processed":false,"images":["https://img.example.com/b'), key, F.lit('.png","https://img.example.com/icon.png"]}')
        ),
        '{"nlp_processed":true,"nlp_error":"timeout","images":[]}',
    )
    return d.select(
        doc.alias("id"),
        F.regexp_extract("source", "([0-9]+)", 1).cast("int").alias("source_id"),
        F.concat(F.lit("https://news.example.com/"), F.col("lang"), F.lit("/"), key, tail).alias("url"),
        F.substring(F.substring_index("text", "\n", 1), 1, 500).alias("title"),
        F.col("text").alias("content"),
        _choose(doc % 3, None, "", F.substring("text", 1, 120)).alias("summary"),
        F.concat(F.lit("author"), (doc % 17).cast("string")).alias("author"),
        published.alias("published_at"),
        F.timestamp_add("MINUTE", doc % 30, published).alias("crawled_at"),
        F.col("lang").alias("category"),
        F.lit(None).cast("double").alias("sentiment_score"),
        meta.alias("metadata"),
    )


def crawl_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    text = key.cast("string")
    return s.select(
        key.cast("int").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("https://s"), text, F.lit(".example.com")).alias("base_url"),
        _choose(F.col("s_nationkey") % 3, "news", "community", "market_feed_site").alias("category"),
        (F.lit(10) + key % 3 * 5).cast("int").alias("crawl_interval_minutes"),
        (F.col("s_acctbal") >= 0).alias("is_active"),
        _choose(
            key % 4,
            "{}",
            '{"collector_type":"us_market_signal","target_url_or_query":"fed"}',
            F.concat(
                F.lit('{"collector_type":"target_site","target_url":"https://feed.example.com/'), text, F.lit('","feed_category":"macro"}')
            ),
            None,
        ).alias("ai_parsing_hints"),
    )


def shape_events(e: DataFrame) -> DataFrame:
    """Event log columns from the driver's event columns; works on batch and streaming frames."""
    kind = F.col("event_type")
    mapped = F.lit(None).cast("string")
    for old, new in EVENT_TYPES.items():
        mapped = F.when(kind == old, new).otherwise(mapped)
    # one event in eleven becomes a signal kind, so that every class occurs
    mapped = (
        F.when(F.col("event_id") % 11 == 3, "market_signal_detected").when(F.col("event_id") % 11 == 7, "trend_spike_detected").otherwise(mapped)
    )
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("int").alias("source_id"),
        mapped.alias("event_type"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("title"),
        F.concat(F.lit("https://s"), F.col("user_id").cast("string"), F.lit(".example.com/"), json_text("props", "k")).alias("url"),
        F.col("props").alias("details"),
        F.col("ts").alias("created_at"),
    )


def crawl_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(table(spark, sf_dir, "events"))


def shape_feedbacks(e: DataFrame) -> DataFrame:
    return e.where(F.col("event_type").isin("view", "click")).select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        json_text("props", "k").cast("long").alias("article_id"),
        F.when(F.col("event_type") == "click", "click").otherwise("impression").alias("event_type"),
        F.col("ts").alias("created_at"),
    )


def feedbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_feedbacks(table(spark, sf_dir, "events"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("article_id"),
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("comment_ext_id"),
        F.col("role").alias("author"),
        F.col("text").alias("content"),
        (F.length("text") % 100).cast("int").alias("score"),
        F.col("turn").cast("int").alias("depth"),
        from_epoch(F.lit(ARTICLES_START_EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("published_at"),
    )


def article_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    url = F.concat(F.lit("https://img.example.com/"), key, F.lit(".png"))
    return p.select(
        F.col("p_partkey").alias("id"),
        F.floor(F.col("p_partkey") / 4).cast("long").alias("article_id"),
        url.alias("image_url"),
        (F.col("p_partkey") % 4 + 1).cast("int").alias("order_index"),
        F.concat(F.lit("{{IMG:"), (F.col("p_partkey") % 4 + 1).cast("string"), F.lit(":"), url, F.lit("}}")).alias("placeholder_token"),
        _choose(F.col("p_size") % 4, "PENDING", "PROCESSING", "COMPLETED", "FAILED").alias("status"),
        F.col("p_name").alias("description"),
    )


def stock_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: one code per brand, one bar per shipping day, prices per piece."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    piece = F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("long")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    qty = F.col("l_quantity").cast("long")
    side = F.when(F.col("l_suppkey") % 2 == 0, qty).otherwise(-qty)
    desk = F.when(F.col("l_suppkey") % 3 == 0, qty).otherwise(-qty)
    rows = line.select(
        F.col("l_shipdate").cast("date").alias("target_dt"), F.col("p_brand").alias("code"), piece.alias("piece"), order.alias("ord"),
        qty.alias("qty"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), side.alias("side"), desk.alias("desk"),
    )
    return rows.groupBy("target_dt", "code").agg(
        F.concat(F.lit("Name "), F.first("code")).alias("name"),
        F.min_by("piece", "ord").alias("open_price"),
        F.max("piece").alias("high_price"),
        F.min("piece").alias("low_price"),
        F.max_by("piece", "ord").alias("close_price"),
        F.sum("qty").alias("volume"),
        F.sum("amount").cast("double").alias("amount"),
        F.sum("side").alias("foreigner"),
        F.sum("desk").alias("institution"),
    )


def stock_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All codes of all days with the change from open to close in percent."""
    return snapshot_of(stock_daily(spark, sf_dir))


def snapshot_of(bars: DataFrame) -> DataFrame:
    """The snapshot rows of daily bars."""
    return bars.select(
        "target_dt", "code", "name", F.col("close_price").alias("close"), "volume", "amount",
        ((F.col("close_price") - F.col("open_price")).cast("double") / F.col("open_price") * 100.0).alias("change_ratio"),
    )
