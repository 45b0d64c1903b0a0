"""Queries on ingestion events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import events as ev
from tidewire.operators import sinks
from tidewire.plans.registry import query, stamp
from tidewire.plans.views import with_views
from tidewire.sources import standins

AS_OF = standins.EVENTS_AS_OF
CLASS_SQL = """CASE WHEN event_type = 'seed_scan' THEN 'seed_scan' WHEN event_type = 'article_ingest' THEN 'article_ingest'
  WHEN contains(event_type, 'image') THEN 'image_ingest' WHEN event_type = 'llm_enrich' OR contains(event_type, 'market_signal') THEN 'llm_enrich'
  WHEN event_type = 'error' THEN 'error' END"""
_FMT = {"HH:mm": "%H:%M", "HH:mm:ss": "%H:%M:%S", "HH:00": "%H:00", "MM-dd": "%m-%d", "MM-dd HH:mm": "%m-%d %H:%M"}


def lanes_sql(preset: str) -> str:
    start, buckets, step, label = ev.lane_window(AS_OF, preset)
    sums = ", ".join(f"count(*) FILTER (cls = '{c}') AS {c}" for c in ev.CLASSES)
    return (
        with_views("crawl_events", "crawl_sources", "articles")
        + f""",
win AS (SELECT *, CAST(floor(epoch(created_at)) AS BIGINT) AS ep, {CLASS_SQL} AS cls FROM crawl_events
  WHERE created_at >= make_timestamp({start}000000) AND created_at < make_timestamp({start + buckets * step}000000)),
b AS (SELECT *, (ep - {start}) // {step} AS bucket FROM win),
parts AS (
  SELECT 'total' AS lane, bucket, {sums} FROM b GROUP BY 2
  UNION ALL SELECT CAST(source_id AS VARCHAR), bucket, {sums.replace("cls = 'llm_enrich'", "false")} FROM b GROUP BY 1, 2
  UNION ALL SELECT 'llm', bucket, 0, 0, 0, count(*) FILTER (cls = 'llm_enrich'), 0 FROM b GROUP BY 2),
lane_names AS (SELECT CAST(id AS VARCHAR) AS lane, 'source' AS category FROM crawl_sources UNION ALL SELECT 'total', 'total' UNION ALL SELECT 'llm', 'type'),
spine AS (SELECT lane, category, bucket FROM lane_names, range({buckets}) r(bucket)),
lanes AS (SELECT s.lane, s.category, s.bucket,
  strftime(make_timestamp(({start}::BIGINT + s.bucket * {step} + 32400) * 1000000), '{_FMT[label]}') AS label,
  {", ".join(f"coalesce(p.{c}, 0) AS {c}" for c in ev.CLASSES)},
  CASE WHEN s.lane = 'llm' THEN coalesce(p.llm_enrich, 0) ELSE coalesce(p.seed_scan + p.article_ingest + p.image_ingest, 0) END AS requests
  FROM spine s LEFT JOIN parts p ON p.lane = s.lane AND p.bucket = s.bucket),
rated AS (SELECT *, seed_scan + article_ingest + image_ingest + llm_enrich + error AS total,
  CAST(round(CAST(requests / {float(step)}::DOUBLE AS DECIMAL(38,10)), 3) AS DOUBLE) AS rate FROM lanes),
summary AS (SELECT lane, category, max(rate) AS peak_rate,
  CAST(round(CAST(CAST(sum(CAST(round(rate * 1000) AS BIGINT)) AS DOUBLE) / {float(buckets)}::DOUBLE / 1000.0::DOUBLE AS DECIMAL(38,10)), 3) AS DOUBLE) AS avg_rate,
  CAST(sum(CASE WHEN bucket = {buckets - 1} THEN requests ELSE 0 END) AS BIGINT) AS current_count, CAST(sum(requests) AS BIGINT) AS total_count
  FROM rated GROUP BY 1, 2)
"""
    )


def _lanes(spark, d, preset):
    return ev.lane_stream(standins.crawl_events(spark, d), standins.crawl_sources(spark, d), AS_OF, preset)


for _preset in ("7d", "1d", "1h", "10m", "1m"):

    @query(f"A11_lane_stream_{_preset}", lanes_sql(_preset) + "SELECT * FROM rated")
    def _(spark, d, preset=_preset):
        return _lanes(spark, d, preset)


for _preset in ("7d", "1d"):

    @query(f"A12_lane_summary_{_preset}", lanes_sql(_preset) + "SELECT * FROM summary")
    def _(spark, d, preset=_preset):
        return ev.lane_summary(_lanes(spark, d, preset), ev.lane_window(AS_OF, preset)[1])


@query(
    "A13_rate_compliance",
    lanes_sql("7d")
    + """SELECT coalesce(bool_and(peak_rate <= 1.05) FILTER (category = 'source'), true) AS compliant,
  max(peak_rate) FILTER (category = 'total') AS global_max_rate, count(*) AS active_lanes, (SELECT count(*) FROM win) AS total_events,
  (SELECT strftime(max(created_at), '%Y-%m-%d %H:%M:%S') FROM win) AS latest_event,
  (SELECT count(*) FROM (SELECT url FROM articles GROUP BY url HAVING count(*) > 1) q) AS duplicate_count FROM summary""",
)
def _(spark, d):
    events = standins.crawl_events(spark, d)
    summary = ev.lane_summary(_lanes(spark, d, "7d"), ev.lane_window(AS_OF, "7d")[1])
    out = ev.rate_compliance(summary, ev.in_window(events, AS_OF, "7d"), standins.articles(spark, d))
    return out.withColumn("latest_event", stamp("latest_event"))


def series_sql(preset: str, source: int | None) -> str:
    buckets, step, label = ev.SERIES_PRESETS[preset]
    where = f"created_at >= TIMESTAMP '{AS_OF}' - INTERVAL {buckets * step} SECONDS" + (f" AND source_id = {source}" if source is not None else "")
    kinds = ev.CLASSES[:4]
    return (
        with_views("crawl_events")
        + f""", w AS (SELECT * FROM crawl_events WHERE {where}),
c AS (SELECT CAST(floor((epoch_us(created_at) - epoch_us(TIMESTAMP '{AS_OF}' - INTERVAL {buckets * step} SECONDS)) / ({step} * 1000000.0)) AS BIGINT) AS bucket,
  {", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in kinds)} FROM w GROUP BY 1)
SELECT r.bucket, strftime(TIMESTAMP '{AS_OF}' - INTERVAL {buckets * step} SECONDS + to_seconds(r.bucket * {step}) + INTERVAL 9 HOURS, '{_FMT[label]}') AS label,
  {", ".join(f"coalesce({k}, 0) AS {k}" for k in kinds)}
FROM range({buckets}) r(bucket) LEFT JOIN c ON c.bucket = r.bucket"""
    )


for _preset, _source in (("10m", None), ("1h", None), ("1d", None), ("7d", None), ("7d", 8)):

    @query(f"A10_event_timeseries_{_preset}" + ("" if _source is None else "_one_source"), series_sql(_preset, _source))
    def _(spark, d, preset=_preset, source=_source):
        return ev.event_timeseries(standins.crawl_events(spark, d), AS_OF, preset, "all" if source is None else source)


@query(
    "A10_event_totals",
    with_views("crawl_events")
    + f"""SELECT count(*) FILTER (event_type = 'article_ingest') AS total_articles, count(*) FILTER (event_type = 'image_ingest') AS total_images,
  count(*) FILTER (event_type = 'llm_enrich') AS total_llm_enriched FROM crawl_events WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS""",
)
def _(spark, d):
    return ev.event_totals(standins.crawl_events(spark, d), AS_OF, "7d", "not a number")


@query(
    "J11_bucket_spine",
    with_views("crawl_sources") + "SELECT id AS lane, bucket FROM crawl_sources, range(56) r(bucket)",
)
def _(spark, d):
    return ev.bucket_spine(standins.crawl_sources(spark, d).select(F.col("id").alias("lane")), 56)


@query(
    "J1_events_with_source",
    with_views("crawl_events", "crawl_sources")
    + """SELECT e.id, e.source_id, s.name AS source_name, e.event_type, e.title, e.url, e.details, strftime(e.created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM crawl_events e LEFT JOIN crawl_sources s ON s.id = e.source_id ORDER BY e.created_at DESC, e.id DESC LIMIT 50""",
)
def _(spark, d):
    return ev.events_with_source(standins.crawl_events(spark, d), standins.crawl_sources(spark, d)).withColumn("created_at", stamp("created_at"))


@query(
    "F8_recent_signals",
    with_views("crawl_events")
    + f"""SELECT id, source_id, event_type, title, url, details, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM crawl_events
WHERE event_type IN {ev.SIGNAL_KINDS} ORDER BY id DESC LIMIT 20""",
)
def _(spark, d):
    return ev.recent_signals(standins.crawl_events(spark, d)).withColumn("created_at", stamp("created_at"))


@query(
    "A9_dashboard_counts",
    with_views("articles", "crawl_sources", "crawl_events")
    + f"""SELECT count(*) AS total_articles, count(*) FILTER (crawled_at >= TIMESTAMP '{standins.ARTICLES_AS_OF}' - INTERVAL 1 DAY) AS articles_24h,
  count(*) FILTER (crawled_at >= date_trunc('day', TIMESTAMP '{standins.ARTICLES_AS_OF}' + INTERVAL 9 HOURS) - INTERVAL 9 HOURS) AS articles_today,
  (SELECT count(*) FILTER (is_active) FROM crawl_sources) AS active_sources,
  (SELECT CAST(round(CAST(CAST(count(*) - count(*) FILTER (event_type = 'error') AS DOUBLE) / CAST(nullif(count(*), 0) AS DOUBLE) * 100.0::DOUBLE AS DECIMAL(38,10)), 1) AS DOUBLE)
   FROM crawl_events WHERE created_at >= TIMESTAMP '{standins.ARTICLES_AS_OF}' - INTERVAL 1 DAY) AS success_rate_24h
FROM articles""",
)
def _(spark, d):
    return ev.dashboard_counts(standins.articles(spark, d), standins.crawl_sources(spark, d), standins.crawl_events(spark, d), standins.ARTICLES_AS_OF)


@query(
    "A9_success_rate",
    with_views("articles", "crawl_sources", "crawl_events")
    + f"""SELECT (SELECT count(*) FROM articles WHERE crawled_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) AS articles_24h,
  CAST(round(CAST(CAST(count(*) - count(*) FILTER (event_type = 'error') AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0::DOUBLE AS DECIMAL(38,10)), 1) AS DOUBLE) AS success_rate_24h
FROM crawl_events WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY""",
)
def _(spark, d):
    out = ev.dashboard_counts(standins.articles(spark, d), standins.crawl_sources(spark, d), standins.crawl_events(spark, d), AS_OF)
    return out.select("articles_24h", "success_rate_24h")


@query("A14_duplicate_titles", with_views("articles") + "SELECT count(*) AS duplicates FROM (SELECT title FROM articles GROUP BY 1 HAVING count(*) > 1) q")
def _(spark, d):
    return ev.duplicate_keys(standins.articles(spark, d), "title")


@query(
    "W1_recent_calls",
    lanes_sql("7d")
    + """, calls AS (SELECT *, lag(created_at) OVER w AS prev, row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, id DESC) AS r FROM win
  WHERE cls IN ('seed_scan', 'article_ingest', 'image_ingest') AND source_id IN (SELECT id FROM crawl_sources) WINDOW w AS (PARTITION BY source_id ORDER BY created_at, id)),
g AS (SELECT *, coalesce(CAST(round(CAST((epoch_us(created_at) - epoch_us(prev)) / 1000000.0::DOUBLE AS DECIMAL(38,10)), 2) AS DOUBLE), 0.0::DOUBLE) AS gap FROM calls WHERE r <= 15)
SELECT source_id, id, event_type, strftime(created_at + INTERVAL 9 HOURS, '%H:%M:%S') AS time_label, title, url, gap AS interval_seconds,
  CASE WHEN gap > 0 THEN CAST(round(CAST(1.0::DOUBLE / gap AS DECIMAL(38,10)), 2) AS DOUBLE) ELSE 0.0::DOUBLE END AS instant_rate FROM g""",
)
def _(spark, d):
    return ev.recent_calls(standins.crawl_events(spark, d), standins.crawl_sources(spark, d), AS_OF, "7d")


@query(
    "W7_inter_arrival",
    with_views("crawl_events")
    + r""", c AS (SELECT id, created_at, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)) AS domain FROM crawl_events),
g AS (SELECT *, (epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY domain ORDER BY created_at, id))) / 1000000.0::DOUBLE AS gap FROM c)
SELECT domain, count(*) AS calls, count(*) FILTER (gap < 1.5) AS violations, min(gap) AS min_gap,
  CAST(round(CAST(CAST(count(*) AS DOUBLE) / greatest((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1000000.0::DOUBLE, 1.0::DOUBLE) AS DECIMAL(38,10)), 3) AS DOUBLE) AS mean_rate
FROM g GROUP BY 1""",
)
def _(spark, d):
    return ev.inter_arrival(standins.crawl_events(spark, d))


@query(
    "K10_retain",
    with_views("crawl_events") + f"SELECT id, source_id, event_type FROM crawl_events WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS",
)
def _(spark, d):
    return sinks.retain(standins.crawl_events(spark, d), AS_OF).select("id", "source_id", "event_type")


@query(
    "A15_mention_surge",
    f"""WITH m AS (SELECT props->>'$.k' AS term, ts AS created_at FROM events),
c AS (SELECT term, count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTES) AS mentions,
  count(*) FILTER (created_at < TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTES) AS before FROM m
  WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 120 MINUTES AND created_at < TIMESTAMP '{AS_OF}' GROUP BY 1),
r AS (SELECT *, CAST(round(CAST(CAST(mentions - before AS DOUBLE) / nullif(before, 0) * 100.0::DOUBLE AS DECIMAL(38,10)), 1) AS DOUBLE) AS rise FROM c WHERE mentions > 0)
SELECT *, CAST(row_number() OVER (ORDER BY mentions DESC, rise DESC NULLS FIRST, term) AS INTEGER) AS rank FROM r QUALIFY rank <= 20""",
)
def _(spark, d):
    mentions = standins.table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("term"), F.col("ts").alias("created_at"))
    return ev.mention_surge(mentions, AS_OF)


@query(
    "A18_backfill_progress",
    """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey AS pos, CASE o_orderstatus WHEN 'F' THEN 'saved' WHEN 'O' THEN 'skipped' ELSE 'error' END AS outcome FROM orders),
n AS (SELECT *, coalesce(sum(CASE WHEN outcome = 'saved' THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (outcome = 'saved') AS saved, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'error') AS error
FROM n WHERE before < 2 GROUP BY 1""",
)
def _(spark, d):
    o = standins.table(spark, d, "orders")
    status = F.col("o_orderstatus")
    attempts = o.select(
        F.to_date("o_orderdate").alias("day"),
        F.col("o_orderkey").alias("pos"),
        F.when(status == "F", "saved").when(status == "O", "skipped").otherwise("error").alias("outcome"),
    )
    return ev.backfill_progress(attempts, 2).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
