"""Ingestion events: lanes and buckets, rates, dashboards and audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.core import (
    LOCAL_OFFSET_HOURS,
    epoch_micros,
    epoch_seconds,
    from_epoch,
    local_label,
    local_time,
    round_half_up,
    seconds_between,
    ts_literal,
)
from tidewire.functions.urls import url_domain
from tidewire.operators.keys import gaps_between_times, top_per

# Preset -> (buckets, seconds per bucket, label). The last preset is the default.
SERIES_PRESETS = {"10m": (10, 60, "HH:mm"), "1h": (12, 300, "HH:mm"), "1d": (24, 3600, "HH:00"), "7d": (7, 86400, "MM-dd")}
LANE_PRESETS = {
    "1m": (60, 1, "HH:mm:ss"), "10m": (60, 10, "HH:mm:ss"), "1h": (60, 60, "HH:mm"), "1d": (48, 1800, "MM-dd HH:mm"),
    "24h": (48, 1800, "MM-dd HH:mm"), "7d": (56, 10800, "MM-dd HH:mm"),
}
SIGNAL_KINDS = ("market_signal_detected", "trend_spike_detected", "smart_seed_extracted", "topic_graph_expanded")
CLASSES = ("seed_scan", "article_ingest", "image_ingest", "llm_enrich", "error")
REQUEST_CLASSES = CLASSES[:3]
MAX_RATE = 1.05
MIN_GAP_SECONDS = 1.5


def as_datetime(as_of: str | dt.datetime) -> dt.datetime:
    return as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(as_of)


def _epoch(at: dt.datetime) -> int:
    return int((at - dt.datetime(1970, 1, 1)).total_seconds())


def event_class(kind: Column | str = "event_type") -> Column:
    """The class of an event, null for kinds that are not counted; the tests apply in this order."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    return (
        F.when(kind == "seed_scan", "seed_scan")
        .when(kind == "article_ingest", "article_ingest")
        .when(F.contains(kind, F.lit("image")), "image_ingest")
        .when((kind == "llm_enrich") | F.contains(kind, F.lit("market_signal")), "llm_enrich")
        .when(kind == "error", "error")
    )


def bucket_spine(lanes: DataFrame, buckets: int) -> DataFrame:
    """Every bucket 0..buckets-1 of every lane (J11), generated per lane row without a join."""
    return lanes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))


def events_with_source(events: DataFrame, sources: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` events with the source name (J1). The limit comes before the join: ids of sources are unique."""
    newest = events.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return newest.join(names, "source_id", "left")


def recent_signals(events: DataFrame, n: int = 20) -> DataFrame:
    """The newest signal events by id (F8)."""
    return events.where(F.col("event_type").isin(list(SIGNAL_KINDS))).orderBy(F.desc("id")).limit(n)


def dashboard_counts(articles: DataFrame, sources: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """One row of head-line numbers (A9); each table is read once."""
    now = ts_literal(as_of)
    day_ago = now - F.make_dt_interval(days=F.lit(1))
    midnight = F.timestamp_add("HOUR", F.lit(-LOCAL_OFFSET_HOURS), F.date_trunc("day", local_time(now)).cast("timestamp_ntz"))
    recent = events.where(F.col("created_at") >= day_ago)
    total = F.count("*")
    rate = F.try_divide((total - F.count_if(F.col("event_type") == "error")).cast("double"), total.cast("double")) * 100.0
    return articles.agg(
        F.count("*").alias("total_articles"),
        F.count_if(F.col("crawled_at") >= day_ago).alias("articles_24h"),
        F.count_if(F.col("crawled_at") >= midnight).alias("articles_today"),
    ).select(
        "*",
        sources.agg(F.count_if("is_active")).scalar().alias("active_sources"),
        recent.agg(round_half_up(rate, 1)).scalar().alias("success_rate_24h"),
    )


def _series_window(events: DataFrame, as_of, preset: str, source: str | int | None):
    buckets, step, label = SERIES_PRESETS.get(preset, SERIES_PRESETS["7d"])
    start = as_datetime(as_of) - dt.timedelta(seconds=buckets * step)
    rows = events.where(F.col("created_at") >= ts_literal(start))
    try:
        rows = rows.where(F.col("source_id") == int(source))
    except (TypeError, ValueError):
        pass
    return rows, start, buckets, step, label


def event_timeseries(events: DataFrame, as_of, preset: str = "10m", source: str | int | None = "all") -> DataFrame:
    """Counts of four kinds per bucket (A10). The window starts unaligned at as_of minus the range; gaps are zero."""
    rows, start, buckets, step, label = _series_window(events, as_of, preset, source)
    offset = epoch_micros("created_at") - F.lit(_epoch(start) * 1_000_000 + start.microsecond)
    counts = (
        rows.withColumn("bucket", F.floor(offset / F.lit(step * 1_000_000)).cast("long"))
        .where(F.col("bucket") < buckets)
        .groupBy("bucket")
        .agg(*[F.count_if(F.col("event_type") == c).alias(c) for c in CLASSES[:4]])
    )
    spine = events.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    at = F.timestamp_add("SECOND", F.col("bucket") * step, ts_literal(start))
    return spine.join(counts, "bucket", "left").select(
        "bucket", local_label(at, label).alias("label"), *[F.coalesce(c, F.lit(0)).alias(c) for c in CLASSES[:4]]
    )


def event_totals(events: DataFrame, as_of, preset: str = "10m", source: str | int | None = "all") -> DataFrame:
    """Totals of A10: every event from the start on, also those after the last bucket."""
    rows, *_ = _series_window(events, as_of, preset, source)
    kind = F.col("event_type")
    return rows.agg(
        F.count_if(kind == "article_ingest").alias("total_articles"),
        F.count_if(kind == "image_ingest").alias("total_images"),
        F.count_if(kind == "llm_enrich").alias("total_llm_enriched"),
    )


def lane_window(as_of, preset: str) -> tuple[int, int, int, str]:
    """(start epoch, buckets, step, label) of a lane preset; the end is aligned down to the step."""
    buckets, step, label = LANE_PRESETS.get(preset, LANE_PRESETS["7d"])
    end = _epoch(as_datetime(as_of)) // step * step
    return end - (buckets - 1) * step, buckets, step, label


def in_window(events: DataFrame, as_of, preset: str) -> DataFrame:
    start, buckets, step, _ = lane_window(as_of, preset)
    at = F.col("created_at")
    return events.where((at >= from_epoch(F.lit(start))) & (at < from_epoch(F.lit(start + buckets * step))))


def class_counts(events: DataFrame, *keys: str) -> DataFrame:
    """Counts of the five classes per key."""
    kind = event_class()
    return events.groupBy(*keys).agg(*[F.count_if(kind == c).alias(c) for c in CLASSES])


def lane_stream(events: DataFrame, sources: DataFrame, as_of, preset: str = "10m") -> DataFrame:
    """Class counts and request rate per lane and bucket (A11): one lane for all, one per source, one for enrichment.

    Events are summed once per source and bucket; the total lane is a second, small sum over those rows. Events of
    unknown sources count in the total only, and enrichment never counts in a source lane.
    """
    start, buckets, step, label = lane_window(as_of, preset)
    at = in_window(events, as_of, preset).withColumn("bucket", F.floor((epoch_seconds("created_at") - start) / F.lit(step)).cast("long"))
    per_source = class_counts(at, "source_id", "bucket")
    sums = per_source.groupingSets([[F.col("source_id"), F.col("bucket")], [F.col("bucket")]], "source_id", "bucket").agg(
        F.grouping("source_id").alias("all"), *[F.sum(c).alias(c) for c in CLASSES]
    )
    requests = F.col("seed_scan") + F.col("article_ingest") + F.col("image_ingest")
    zero = F.lit(0).cast("long")

    def lane(name: Column, llm: Column, req: Column, other: bool) -> Column:
        kept = {c: (F.col(c) if other else zero) for c in CLASSES} | {"llm_enrich": llm}
        return F.struct(name.alias("lane"), *[kept[c].alias(c) for c in CLASSES], req.alias("requests"))

    total = lane(F.lit("total"), F.col("llm_enrich"), requests, True)
    enrich = lane(F.lit("llm"), F.col("llm_enrich"), F.col("llm_enrich"), False)
    single = lane(F.col("source_id").cast("string"), zero, requests, True)
    counts = sums.select("bucket", F.inline(F.when(F.col("all") == 1, F.array(total, enrich)).otherwise(F.array(single))))
    fixed = events.sparkSession.range(2).select(
        F.when(F.col("id") == 0, "total").otherwise("llm").alias("lane"), F.when(F.col("id") == 0, "total").otherwise("type").alias("category")
    )
    lanes = sources.select(F.col("id").cast("string").alias("lane"), F.lit("source").alias("category")).unionByName(fixed)
    joined = bucket_spine(lanes, buckets).join(counts, ["lane", "bucket"], "left")
    filled = {c: F.coalesce(c, zero) for c in (*CLASSES, "requests")}
    all_classes = sum((filled[c] for c in CLASSES[1:]), filled[CLASSES[0]])
    return joined.select(
        "lane",
        "category",
        "bucket",
        local_label(from_epoch(F.lit(start) + F.col("bucket") * step), label).alias("label"),
        *[v.alias(k) for k, v in filled.items()],
        all_classes.alias("total"),
        round_half_up(filled["requests"].cast("double") / F.lit(float(step)), 3).alias("rate"),
    )


def lane_summary(lanes: DataFrame, buckets: int) -> DataFrame:
    """Peak, mean over all buckets, last bucket and total per lane."""
    milli = F.sum(F.round(F.col("rate") * 1000).cast("long"))
    return lanes.groupBy("lane", "category").agg(
        F.max("rate").alias("peak_rate"),
        round_half_up(milli.cast("double") / F.lit(float(buckets)) / 1000.0, 3).alias("avg_rate"),
        F.sum(F.when(F.col("bucket") == buckets - 1, F.col("requests")).otherwise(0)).alias("current_count"),
        F.sum("requests").alias("total_count"),
    )


def rate_compliance(summary: DataFrame, window_events: DataFrame, articles: DataFrame) -> DataFrame:
    """One row: are all source lanes slow enough, the global peak, and counts of the window."""
    return summary.agg(
        F.coalesce(F.bool_and(F.when(F.col("category") == "source", F.col("peak_rate") <= MAX_RATE)), F.lit(True)).alias("compliant"),
        F.max(F.when(F.col("category") == "total", F.col("peak_rate"))).alias("global_max_rate"),
        F.count("*").alias("active_lanes"),
    ).select("*", window_events.agg(F.struct(F.count("*").alias("n"), F.max("created_at").alias("latest"))).scalar().alias("__window"), duplicate_keys(articles, "url").scalar().alias("duplicate_count")).select(
        "compliant", "global_max_rate", "active_lanes", F.col("__window.n").alias("total_events"), F.col("__window.latest").alias("latest_event"), "duplicate_count"
    )


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """How many keys occur more than once (A14); one row, one column ``duplicates``."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1).agg(F.count("*").alias("duplicates"))


def recent_calls(events: DataFrame, sources: DataFrame, as_of, preset: str = "10m", n: int = 15) -> DataFrame:
    """The last ``n`` requests of every source with the gap to the request before.

    The gap of the oldest kept call needs one call more, so n + 1 rows per source are ranked (before the shuffle, too)
    and no window ever sees a source's full list.
    """
    calls = in_window(events, as_of, preset).where(event_class().isin(list(REQUEST_CLASSES)))
    known = calls.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    newest = [F.desc("created_at"), F.desc("id")]
    last = top_per(known, ["source_id"], newest, n + 1)
    by_source = W.partitionBy("source_id")
    gap = F.coalesce(round_half_up(seconds_between(F.lag("created_at").over(by_source.orderBy("created_at", "id")), F.col("created_at")), 2), F.lit(0.0))
    return (
        last.withColumn("gap", gap)
        .withColumn("r", F.row_number().over(by_source.orderBy(*newest)))
        .where(F.col("r") <= n)
        .select(
            "source_id",
            "id",
            "event_type",
            local_label("created_at", "HH:mm:ss").alias("time_label"),
            "title",
            "url",
            F.col("gap").alias("interval_seconds"),
            F.when(F.col("gap") > 0, round_half_up(F.try_divide(F.lit(1.0), F.col("gap")), 2)).otherwise(0.0).alias("instant_rate"),
        )
    )


def inter_arrival(events: DataFrame, min_gap: float = MIN_GAP_SECONDS) -> DataFrame:
    """Politeness audit per domain (W7): calls, gaps below the minimum, smallest gap and mean rate."""
    calls = events.select("id", "created_at", url_domain("url").alias("domain"))
    times = gaps_between_times(calls, "domain", "created_at", "id")
    repeats = F.col("n") - 1
    too_soon = repeats + F.when(F.col("gap_seconds") < min_gap, 1).otherwise(0)
    span = F.greatest(seconds_between(F.min("created_at"), F.max("created_at")), F.lit(1.0))
    return times.groupBy("domain").agg(
        F.sum("n").alias("calls"),
        F.sum(too_soon).alias("violations"),
        F.min(F.when(repeats > 0, F.lit(0.0)).otherwise(F.col("gap_seconds"))).alias("min_gap"),
        round_half_up(F.sum("n").cast("double") / span, 3).alias("mean_rate"),
    )


def mention_surge(mentions: DataFrame, as_of, n: int = 20, minutes: int = 60) -> DataFrame:
    """Mentions in the last hour against the hour before (A15); ``mentions`` has term and created_at.

    Ranks are given to the n rows that are kept, so the only window is over n rows.
    """
    now = ts_literal(as_of)
    edge = now - F.make_dt_interval(mins=F.lit(minutes))
    start = now - F.make_dt_interval(mins=F.lit(2 * minutes))
    at = F.col("created_at")
    counts = (
        mentions.where((at >= start) & (at < now))
        .groupBy("term")
        .agg(F.count_if(at >= edge).alias("mentions"), F.count_if(at < edge).alias("before"))
        .where(F.col("mentions") > 0)
    )
    rise = F.try_divide((F.col("mentions") - F.col("before")).cast("double"), F.col("before").cast("double")) * 100.0
    best = [F.desc("mentions"), F.desc_nulls_first("rise"), F.asc("term")]
    top = counts.withColumn("rise", round_half_up(rise, 1)).orderBy(*best).limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*best)))


def scan_summary(links: DataFrame) -> DataFrame:
    """Candidate and new links per source and scan (A20); ``links`` has source_id, scan_id and is_new."""
    return links.groupBy("source_id", "scan_id").agg(F.count("*").alias("candidate_count"), F.count_if("is_new").alias("new_count"))


def backfill_progress(attempts: DataFrame, max_per_day: int = 30) -> DataFrame:
    """Saved, skipped and failed pages per day (A18); ``attempts`` has day, pos and outcome.

    A day stops when ``max_per_day`` articles are saved: only attempts up to that save count. The running number of
    saves is needed only up to the cap, so the cut position comes from the first saves of the day.
    """
    saves = top_per(attempts.where(F.col("outcome") == "saved").select("day", "pos"), ["day"], [F.asc("pos")], max_per_day)
    cut = saves.groupBy("day").agg(F.count("*").alias("kept"), F.max("pos").alias("last"))
    limited = attempts.join(cut, "day", "left").where(
        F.col("kept").isNull() | (F.col("kept") < max_per_day) | (F.col("pos") <= F.col("last"))
    )
    return limited.groupBy("day").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("saved", "skipped", "error")])
