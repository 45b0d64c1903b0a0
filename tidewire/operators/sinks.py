"""Inserts, updates and merges as whole-table expressions, plus the few functions that write.

Parquet has no MERGE, so an update is a new version of the table: ``replace_table`` writes it beside the old one and then
moves the catalog's pointer. One writer per table is assumed. On a catalog with row-level MERGE use ``DataFrame.mergeInto``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.core import round_half_up, ts_literal
from tidewire.operators.keys import first_per_key, top_per

ARTICLE_KEYS = ["url", "published_at"]
TARGET_KEYS = ["target_dt", "code", "strategy_name"]
COMMENT_KEYS = ["article_id", "comment_ext_id"]
TITLE_CHARS, AUTHOR_CHARS, ERROR_CHARS = 500, 100, 200
# Fixed value: what the title of an image event begins with.
IMAGE_TITLE = "이미지: "


def new_rows(target: DataFrame, batch: DataFrame, keys: list[str] = ARTICLE_KEYS, order: str = "pos") -> DataFrame:
    """The rows of a batch an idempotent insert would add (K1): first per key, keys not stored yet."""
    return first_per_key(batch, keys, order).join(target.select(*keys), keys, "left_anti")


def append_new(target: DataFrame, batch: DataFrame, keys: list[str] = ARTICLE_KEYS, order: str = "pos") -> DataFrame:
    """The target after an idempotent insert of the batch."""
    return target.unionByName(new_rows(target, batch, keys, order).select(*target.columns))


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], set_cols: list[str], order: str = "pos") -> DataFrame:
    """Insert new keys and replace only ``set_cols`` of stored ones (K2).

    Repeats of a key inside the batch behave like one statement after another: the first inserts, the last sets.
    """
    rest = [c for c in target.columns if c not in keys and c not in set_cols]
    parts = [F.max_by(F.struct(*set_cols), order).alias("__set")]
    if rest:
        parts.append(F.min_by(F.struct(*rest), order).alias("__rest"))
    new = batch.groupBy(*keys).agg(*parts)
    old = target.withColumn("__old", F.lit(True))
    joined = old.join(new, keys, "full_outer")
    is_new, is_old = F.col("__set").isNotNull(), F.col("__old").isNotNull()
    out: dict[str, Column] = {k: F.col(k) for k in keys}
    for c in rest:
        out[c] = F.when(is_old, F.col(c)).otherwise(F.col(f"__rest.{c}"))
    for c in set_cols:
        out[c] = F.when(is_new, F.col(f"__set.{c}")).otherwise(F.col(c))
    return joined.select(*[out[c].alias(c) for c in target.columns])


def merge_json(target: Column, patch: Column) -> Column:
    """Shallow merge of two JSON objects, the right one wins (K3). Null counts as the empty object."""
    shape = "map<string,variant>"

    def entries(c: Column) -> Column:
        return F.map_entries(F.from_json(F.coalesce(c, F.lit("{}")), shape))

    right = entries(patch)
    right_keys = F.transform(right, lambda e: e["key"])
    kept = F.filter(entries(target), lambda e: ~F.array_contains(right_keys, e["key"]))
    return F.to_json(F.map_from_entries(F.concat(kept, right)))


def failure_patch(reason: Column, at: Column) -> Column:
    """The JSON patch for an article whose analysis failed (K3)."""
    return F.to_json(
        F.struct(
            F.lit(True).alias("nlp_processed"),
            F.substring(reason, 1, ERROR_CHARS).alias("nlp_error"),
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("nlp_failed_at"),
        )
    )


def ingest_events(batch: DataFrame, max_images: int = 3) -> DataFrame:
    """Event rows of ingested articles (K4): one per article and one per image, the first ``max_images`` of each.

    ``batch`` has source_id, title, url, images (array), details (JSON) and created_at. Smart collectors use two images.
    """
    article = F.struct(
        F.lit("article_ingest").alias("event_type"),
        F.substring("title", 1, TITLE_CHARS).alias("title"),
        F.lit(None).cast("string").alias("image_url"),
        F.col("details").alias("details"),
    )
    images = F.transform(
        F.slice(F.coalesce("images", F.array().cast("array<string>")), 1, max_images),
        lambda u: F.struct(
            F.lit("image_ingest").alias("event_type"),
            F.concat(F.lit(IMAGE_TITLE), F.substring("title", 1, 40)).alias("title"),
            u.alias("image_url"),
            F.to_json(F.struct(u.alias("image_url"))).alias("details"),
        ),
    )
    return batch.select("source_id", "url", "created_at", F.inline(F.concat(F.array(article), images)))


def append_events(batch: DataFrame, path: str, max_images: int = 3) -> None:
    """Append ingestion events, one folder per day, which is also the unit of retention."""
    rows = ingest_events(batch, max_images).withColumn("dt", F.to_date("created_at"))
    rows.write.mode("append").partitionBy("dt").parquet(path)


def append_term_freq(rows: DataFrame, path: str) -> None:
    """Append term rows by day (K5), ordered by term and time so that file statistics prune a term lookup."""
    by_day = rows.withColumn("dt", F.to_date("time"))
    by_day.sortWithinPartitions("dt", "term", "time").write.mode("append").partitionBy("dt").parquet(path)


def _beside(edges: DataFrame, batch: DataFrame | None, names: dict[str, str]) -> DataFrame:
    """Edges with the columns of the batch under other names. Without ``batch`` the edges have them beside their own as ``batch_*`` (``cooccurrence_of_both``), null where one side has no such edge."""
    if batch is None:
        return edges.withColumnsRenamed({f"batch_{c}": new for c, new in names.items()})
    return edges.join(batch.select("src", "dst", *[F.col(c).alias(new) for c, new in names.items()]), ["src", "dst"], "full_outer")


def merge_edges(edges: DataFrame, batch: DataFrame | None, at) -> DataFrame:
    """Edge upsert (K6): the batch weight replaces the stored one."""
    out = _beside(edges, batch, {"weight": "__weight"})
    hit = F.col("__weight").isNotNull()
    return out.select(
        "src", "dst", F.coalesce("__weight", "weight").alias("weight"), F.when(hit, ts_literal(at)).otherwise(F.col("updated_at")).alias("updated_at")
    )


def edge_ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()


def merge_nodes(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """Node upsert (K6): stored nodes and the ends of the batch."""
    return nodes.select("name").unionByName(edge_ends(batch)).distinct()


def merge_edges_ema(edges: DataFrame, batch: DataFrame | None, keep: float = 0.8) -> DataFrame:
    """Edge upsert with a moving average (K6b): weight = keep * old + (1 - keep) * new, co_count adds up."""
    out = _beside(edges, batch, {"weight": "__w", "co_count": "__n"})
    both = F.col("weight") * keep + F.col("__w") * round(1 - keep, 10)
    weight = F.when(F.col("__w").isNull(), F.col("weight")).when(F.col("weight").isNull(), F.col("__w")).otherwise(both)
    count = F.coalesce("co_count", F.lit(0)) + F.coalesce("__n", F.lit(0))
    return out.select("src", "dst", round_half_up(weight, 6).alias("weight"), count.alias("co_count"))


def merge_node_counts(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """Node upsert with counts (K6b): counts of (name, count) rows add up."""
    return nodes.select("name", "count").unionByName(batch.select("name", "count")).groupBy("name").agg(F.sum("count").alias("count"))


def save_targets(stored: DataFrame, picks: DataFrame) -> DataFrame:
    """Picks that are not stored yet (K7), keyed by day, code and strategy; of repeats in a batch the best score stays, as the first of a ranked list."""
    best = top_per(picks, TARGET_KEYS, [F.desc("target_score")])
    return best.join(stored.select(*TARGET_KEYS), TARGET_KEYS, "left_anti")


def apply_backtest(targets: DataFrame, results: DataFrame, order: str | None = None) -> DataFrame:
    """Set the six result columns of verified picks (K8), matched by id.

    Of repeated results for an id the last by ``order`` counts (without ``order`` the largest row), so that no target is multiplied.
    """
    cols = ["next_day_open", "next_day_10m_high", "next_day_close", "return_rate_open", "return_rate_high", "is_success"]
    row = F.struct(*cols)
    r = results.groupBy("id").agg((F.max_by(row, order) if order else F.max(row)).alias("__r"))
    hit = F.col("__r").isNotNull()
    return targets.join(r, "id", "left").select(
        *[(F.when(hit, F.col(f"__r.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)) for c in targets.columns]
    )


def apply_enrichment(articles: DataFrame, results: DataFrame, order: str | None = None) -> DataFrame:
    """Set summary and sentiment and merge the JSON patch, matched by (url, published_at) (K9).

    Of repeated results for a key the last by ``order`` counts (without ``order`` the largest row), so that no article is multiplied.
    """
    row = F.struct("summary", "sentiment_score", "patch")
    r = results.groupBy(*ARTICLE_KEYS).agg((F.max_by(row, order) if order else F.max(row)).alias("__r"))
    hit = F.col("__r").isNotNull()
    new = {
        "summary": F.when(hit, F.coalesce("__r.summary", F.lit(""))).otherwise(F.col("summary")),
        "sentiment_score": F.when(hit, F.coalesce("__r.sentiment_score", F.lit(0.0))).otherwise(F.col("sentiment_score")),
        "metadata": F.when(hit, merge_json(F.col("metadata"), F.col("__r.patch"))).otherwise(F.col("metadata")),
    }
    return articles.join(r, ARTICLE_KEYS, "left").select(*[new.get(c, F.col(c)).alias(c) for c in articles.columns])


def retain(events: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Events of the last days (K10). On the stored layout the same filter on ``dt`` drops whole folders."""
    cutoff = ts_literal(as_of) - F.make_dt_interval(days=F.lit(days))
    rows = events.where(F.col("created_at") >= cutoff)
    return rows.where(F.col("dt") >= F.to_date(cutoff)) if "dt" in events.columns else rows


def article_row(batch: DataFrame) -> DataFrame:
    """Cut texts to the stored widths and fill defaults the way every insert does."""
    return batch.withColumns(
        {"title": F.substring("title", 1, TITLE_CHARS), "author": F.substring("author", 1, AUTHOR_CHARS)}
    )


def replace_table(df: DataFrame, name: str, base: str) -> str:
    """Write a new version of a table below ``base`` and point the catalog entry ``name`` at it.

    Readers of the old version keep their files; remove old versions when no reader is left.
    """
    spark = df.sparkSession
    path = f"{base.rstrip('/')}/{name}/v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
        spark.catalog.refreshTable(name)
    else:
        spark.catalog.createTable(name, path=path, source="parquet")
    return path

