"""Queries on market data and picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import quant, reco, sinks
from tidewire.plans.registry import day, query, stamp
from tidewire.plans.views import with_views
from tidewire.session import scratch_dir
from tidewire.sources import articles as article_scans
from tidewire.sources import standins

TODAY = standins.MARKET_AS_OF
# Amounts of the stand-in bars are far smaller than those of an exchange.
AMOUNT, UNIT = 30000.0, 1e5
R = "CAST(round(CAST({} AS DECIMAL(38,10)), {}) AS DOUBLE)"

PICKS_SQL = with_views("stock_snapshot", "feedbacks") + f""",
scored AS (SELECT target_dt, code, name, 'CLOSING_MOMENTUM_V1' AS strategy_name, amount / {UNIT}::DOUBLE * 0.5::DOUBLE + change_ratio * 0.5::DOUBLE AS target_score, close AS closing_price
  FROM stock_snapshot WHERE amount >= {AMOUNT} AND change_ratio BETWEEN 3.0 AND 18.0),
picks AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY target_dt ORDER BY target_score DESC, code) <= 5),
targets AS (SELECT date_diff('day', DATE '1990-01-01', target_dt) * 100 + CAST(regexp_extract(code, '[0-9]+') AS BIGINT) AS id, *,
  CAST(NULL AS BIGINT) AS next_day_open, CAST(NULL AS BIGINT) AS next_day_10m_high, CAST(NULL AS BIGINT) AS next_day_close FROM picks),
stored AS (SELECT * EXCLUDE (next_day_open, next_day_10m_high, next_day_close), next_day_open, next_day_10m_high, next_day_close,
  CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 40 AS DOUBLE) / 10 - 1 END AS return_rate_open,
  CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 50 AS DOUBLE) / 10 - 1 END AS return_rate_high,
  CASE WHEN id % 3 = 0 THEN NULL ELSE id % 2 = 0 END AS is_success FROM targets),
pending AS (SELECT * FROM stored WHERE is_success IS NULL AND target_dt < DATE '{TODAY}'),
nth AS (SELECT p.id, b.*, row_number() OVER (PARTITION BY p.id ORDER BY b.target_dt) AS r FROM pending p JOIN stock_daily b ON b.code = p.code AND b.target_dt >= p.target_dt),
matched AS (SELECT p.id, p.code, p.target_dt, p.closing_price, n.target_dt AS next_dt, n.open_price AS next_day_open, n.high_price AS next_day_10m_high, n.close_price AS next_day_close
  FROM pending p JOIN nth n ON n.id = p.id AND n.r = 2),
verified AS (SELECT *, {R.format("CAST(next_day_open - closing_price AS DOUBLE) / closing_price * 100.0::DOUBLE", 2)} AS return_rate_open,
  {R.format("CAST(next_day_10m_high - closing_price AS DOUBLE) / closing_price * 100.0::DOUBLE", 2)} AS return_rate_high,
  CAST(next_day_10m_high - closing_price AS DOUBLE) / closing_price * 100.0::DOUBLE >= 1.5 AS is_success FROM matched)
"""
_D = "strftime(target_dt, '%Y-%m-%d') AS target_dt"


def _bars(spark, d):
    """The daily bars, written once for queries that read them several times; one row per code and day."""
    path, bars = scratch_dir(spark, "daily-bars"), standins.stock_daily(spark, d)
    bars.write.parquet(path)
    return spark.read.schema(bars.schema).parquet(path)


def _picks(bars):
    return quant.closing_screen(standins.snapshot_of(bars), AMOUNT, UNIT)


def _stored(bars):
    key = F.date_diff("target_dt", F.lit("1990-01-01").cast("date")).cast("long") * 100 + F.regexp_extract("code", "([0-9]+)", 1).cast("long")
    none = F.lit(None).cast("long")
    open_ = F.col("id") % 3 == 0
    return (
        _picks(bars)
        .withColumn("id", key)
        .withColumns({"next_day_open": none, "next_day_10m_high": none, "next_day_close": none})
        .withColumns(
            {
                "return_rate_open": F.when(~open_, (F.col("id") % 40).cast("double") / 10 - 1),
                "return_rate_high": F.when(~open_, (F.col("id") % 50).cast("double") / 10 - 1),
                "is_success": F.when(~open_, F.col("id") % 2 == 0),
            }
        )
    )


def _pending(bars):
    return quant.pending_targets(_stored(bars), TODAY)


def _matched(bars):
    return quant.next_session(_pending(bars).select("id", "code", "target_dt", "closing_price"), bars)


@query("M6_closing_screen", PICKS_SQL + f"SELECT {_D}, code, name, strategy_name, {R.format('target_score', 6)} AS target_score, closing_price FROM picks")
def _(spark, d):
    return _picks(standins.stock_daily(spark, d)).withColumns({"target_dt": day("target_dt"), "target_score": F.round(F.col("target_score").cast("decimal(38,10)"), 6).cast("double")})


@query(
    "W5_score_rank",
    with_views("stock_snapshot")
    + f"SELECT {_D}, code, target_score FROM (SELECT target_dt, code, volume AS target_score FROM stock_snapshot) q QUALIFY row_number() OVER (PARTITION BY q.target_dt ORDER BY target_score DESC, code) <= 5",
)
def _(spark, d):
    scored = standins.stock_snapshot(spark, d).select("target_dt", "code", F.col("volume").alias("target_score"))
    return quant.score_rank(scored).withColumn("target_dt", day("target_dt"))


SURGE_SQL = """, surged AS (SELECT *, volume / mean_volume AS surge FROM (SELECT *, CASE WHEN count(volume) OVER w = 20 THEN CAST(sum(volume) OVER w AS DOUBLE) / 20 END AS mean_volume
  FROM stock_daily WINDOW w AS (PARTITION BY code ORDER BY target_dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) q WHERE volume >= mean_volume * 2)
"""


@query(
    "W4_volume_surge",
    with_views("stock_daily") + SURGE_SQL + f"SELECT {_D}, code, volume, {R.format('mean_volume', 6)} AS mean_volume, {R.format('surge', 6)} AS surge FROM surged",
)
def _(spark, d):
    out = quant.volume_surge(standins.stock_daily(spark, d))
    return out.select(
        day("target_dt").alias("target_dt"), "code", "volume",
        *[F.round(F.col(c).cast("decimal(38,10)"), 6).cast("double").alias(c) for c in ("mean_volume", "surge")],
    )


@query(
    "M6b_closing_screen_flow",
    with_views("stock_daily")
    + SURGE_SQL
    + f""", news AS (SELECT 'Brand#' || (doc_id % 25 + 1) AS code, count(*) AS mentions FROM documents GROUP BY 1),
scored AS (SELECT s.target_dt, s.code, s.name, surge * 10.0::DOUBLE + CAST(foreigner + institution AS DOUBLE) * 0.1::DOUBLE + coalesce(mentions, 0) * 0.5::DOUBLE AS target_score,
  close_price AS closing_price FROM surged s LEFT JOIN news n ON n.code = s.code
  WHERE foreigner > 0 AND institution > 0 AND CAST(close_price - open_price AS DOUBLE) / open_price * 100.0::DOUBLE BETWEEN 3.0 AND 18.0)
SELECT {_D}, code, name, {R.format('target_score', 6)} AS target_score, closing_price FROM scored
QUALIFY row_number() OVER (PARTITION BY scored.target_dt ORDER BY scored.target_score DESC, code) <= 5""",
)
def _(spark, d):
    news = (
        standins.table(spark, d, "documents")
        .groupBy(F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string")).alias("code"))
        .agg(F.count("*").alias("mentions"))
    )
    out = quant.closing_screen_flow(standins.stock_daily(spark, d), news, 10.0, 0.1, 0.5)
    return out.select(
        day("target_dt").alias("target_dt"), "code", "name", F.round(F.col("target_score").cast("decimal(38,10)"), 6).cast("double").alias("target_score"), "closing_price"
    )


@query("F7_pending_targets", PICKS_SQL + f"SELECT id, {_D}, code, closing_price FROM pending")
def _(spark, d):
    return _pending(standins.stock_daily(spark, d)).select("id", day("target_dt").alias("target_dt"), "code", "closing_price")


@query(
    "J4_next_session",
    PICKS_SQL + f"SELECT id, code, {_D}, closing_price, strftime(next_dt, '%Y-%m-%d') AS next_dt, next_day_open, next_day_10m_high, next_day_close FROM matched",
)
def _(spark, d):
    return _matched(_bars(spark, d)).withColumns({"target_dt": day("target_dt"), "next_dt": day("next_dt")})


@query(
    "W3_next_session_of_orders",
    """WITH days AS (SELECT DISTINCT 'x' AS code, CAST(l_shipdate AS DATE) AS dt FROM lineitem),
led AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS next_dt FROM days)
SELECT o_orderkey AS id, strftime((SELECT arg_min(next_dt, dt) FROM led WHERE dt >= CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS next_dt FROM orders
WHERE (SELECT count(*) FROM days WHERE dt >= CAST(o_orderdate AS DATE)) >= 2""",
)
def _(spark, d):
    bars = (
        standins.table(spark, d, "lineitem")
        .select(F.lit("x").alias("code"), F.to_date("l_shipdate").alias("target_dt"))
        .distinct()
        .withColumns({c: F.lit(1).cast("long") for c in ("open_price", "high_price", "close_price")})
    )
    orders = standins.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("x").alias("code"), F.to_date("o_orderdate").alias("target_dt"))
    return quant.next_session(orders, bars).select("id", day("next_dt").alias("next_dt"))


@query(
    "M7_backtest_returns",
    PICKS_SQL + "SELECT id, next_day_open, next_day_10m_high, next_day_close, return_rate_open, return_rate_high, is_success FROM verified",
)
def _(spark, d):
    return quant.backtest_returns(_matched(_bars(spark, d))).select(
        "id", "next_day_open", "next_day_10m_high", "next_day_close", "return_rate_open", "return_rate_high", "is_success"
    )


@query(
    "M7b_backtest_from_open",
    PICKS_SQL
    + f"""SELECT id, {R.format("CAST(next_day_10m_high - next_day_open AS DOUBLE) / next_day_open * 100.0::DOUBLE", 2)} AS return_rate_high,
  CAST(next_day_10m_high - next_day_open AS DOUBLE) / next_day_open * 100.0::DOUBLE >= 2.0 AS is_success FROM matched""",
)
def _(spark, d):
    return quant.backtest_returns_from_open(_matched(_bars(spark, d))).select("id", "return_rate_high", "is_success")


@query(
    "K8_apply_backtest",
    PICKS_SQL
    + """SELECT s.id, coalesce(v.next_day_open, s.next_day_open) AS next_day_open, coalesce(v.next_day_10m_high, s.next_day_10m_high) AS next_day_10m_high,
  coalesce(v.next_day_close, s.next_day_close) AS next_day_close, coalesce(v.return_rate_open, s.return_rate_open) AS return_rate_open,
  coalesce(v.return_rate_high, s.return_rate_high) AS return_rate_high, coalesce(v.is_success, s.is_success) AS is_success
FROM stored s LEFT JOIN verified v ON v.id = s.id""",
)
def _(spark, d):
    bars = _bars(spark, d)
    out = sinks.apply_backtest(_stored(bars), quant.backtest_returns(_matched(bars)))
    return out.select("id", "next_day_open", "next_day_10m_high", "next_day_close", "return_rate_open", "return_rate_high", "is_success")


@query(
    "A6_quant_stats",
    PICKS_SQL
    + f"""SELECT count(*) AS total_trades, count(*) FILTER (is_success) AS success_trades,
  {R.format("CAST(count(*) FILTER (is_success) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0::DOUBLE", 2)} AS win_rate,
  {R.format("avg(CAST(return_rate_open AS DECIMAL(18,4)))", 2)} AS avg_return_rate_open, {R.format("avg(CAST(return_rate_high AS DECIMAL(18,4)))", 2)} AS avg_return_rate_high
FROM stored""",
)
def _(spark, d):
    return quant.quant_stats(_stored(standins.stock_daily(spark, d)))


@query(
    "F11_closing_targets",
    PICKS_SQL + f"SELECT id, {_D}, code, closing_price, is_success FROM stored ORDER BY stored.target_dt DESC, target_score DESC, code LIMIT 20",
)
def _(spark, d):
    return quant.closing_targets(_stored(standins.stock_daily(spark, d))).select("id", day("target_dt").alias("target_dt"), "code", "closing_price", "is_success")


@query(
    "K7_save_targets",
    PICKS_SQL + f"SELECT {_D}, code, strategy_name, closing_price FROM picks WHERE picks.target_dt >= DATE '1999-01-01'",
)
def _(spark, d):
    picks = _picks(_bars(spark, d))
    stored = picks.where(F.col("target_dt") < F.lit("1999-01-01").cast("date"))
    return sinks.save_targets(stored, picks).select(day("target_dt").alias("target_dt"), "code", "strategy_name", "closing_price")


@query(
    "F12_daily_bars",
    with_views("stock_daily") + f"SELECT {_D}, code, open_price, high_price, low_price, close_price, volume FROM stock_daily WHERE code = 'Brand#3' ORDER BY stock_daily.target_dt DESC LIMIT 60",
)
def _(spark, d):
    out = quant.daily_bars(standins.stock_daily(spark, d), "Brand#3")
    return out.select(day("target_dt").alias("target_dt"), "code", "open_price", "high_price", "low_price", "close_price", "volume")


@query(
    "S8_stock_snapshot",
    with_views("stock_daily") + f"SELECT {_D}, code, close_price, volume, foreigner, institution FROM stock_daily WHERE target_dt = DATE '2000-03-01'",
)
def _(spark, d):
    out = article_scans.stock_snapshot(standins.stock_daily(spark, d), "2000-03-01")
    return out.select(day("target_dt").alias("target_dt"), "code", "close_price", "volume", "foreigner", "institution")


@query(
    "S8_price_history",
    with_views("stock_daily") + f"SELECT {_D}, open_price, high_price, low_price, close_price FROM stock_daily WHERE code = 'Brand#5' AND target_dt >= DATE '1999-01-01'",
)
def _(spark, d):
    out = article_scans.price_history(standins.stock_daily(spark, d), "Brand#5", "1999-01-01")
    return out.select(day("target_dt").alias("target_dt"), "open_price", "high_price", "low_price", "close_price")


COUNTS_SQL = with_views("articles", "feedbacks") + """, counts AS (SELECT article_id, count(*) FILTER (event_type = 'click') AS clicks,
  count(*) FILTER (event_type = 'impression') AS impressions FROM feedbacks GROUP BY 1)
"""


@query("A5_feedback_counts", COUNTS_SQL + "SELECT * FROM counts")
def _(spark, d):
    return reco.feedback_counts(standins.feedbacks(spark, d))


@query(
    "J2_feedback_stats_for",
    COUNTS_SQL
    + """SELECT a.id, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions FROM articles a LEFT JOIN counts c ON c.article_id = a.id""",
)
def _(spark, d):
    return reco.feedback_stats_for(standins.articles(spark, d).select("id"), standins.feedbacks(spark, d))


@query("M9b_feedback_to_score", with_views("feedbacks") + "SELECT id, article_id, CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM feedbacks")
def _(spark, d):
    return reco.feedback_to_score(standins.feedbacks(spark, d)).select("id", "article_id", "score")


@query(
    "M9_ucb1_scores",
    COUNTS_SQL
    + f""", s AS (SELECT a.id, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions FROM articles a LEFT JOIN counts c ON c.article_id = a.id)
SELECT id, clicks, impressions, CASE WHEN impressions = 0 THEN 'inf'::DOUBLE ELSE
  {R.format("clicks / CAST(impressions AS DOUBLE) + 1.414::DOUBLE * sqrt(ln(CAST(greatest((SELECT sum(impressions) FROM s), 1) AS DOUBLE)) / CAST(nullif(impressions, 0) AS DOUBLE))", 6)} END AS score FROM s""",
)
def _(spark, d):
    return reco.ucb1_scores(reco.feedback_stats_for(standins.articles(spark, d).select("id"), standins.feedbacks(spark, d)))


@query(
    "M8_thompson_inputs",
    COUNTS_SQL
    + """, newest AS (SELECT id FROM articles ORDER BY published_at DESC, id DESC LIMIT 50)
SELECT n.id, coalesce(clicks, 0) + 1 AS alpha, greatest(coalesce(impressions, 0) - coalesce(clicks, 0), 0) + 1 AS beta FROM newest n LEFT JOIN counts c ON c.article_id = n.id""",
)
def _(spark, d):
    newest = reco.latest(standins.articles(spark, d).select("id", "published_at"), "published_at", reco.CANDIDATES)
    return reco.thompson_inputs(reco.feedback_stats_for(newest, standins.feedbacks(spark, d)))


@query("M8_thompson_scores")
def _(spark, d):
    out = reco.recommend(standins.articles(spark, d), standins.feedbacks(spark, d), seed=7)
    return out.withColumn("published_at", stamp("published_at"))


@query(
    "T2_latest",
    with_views("articles") + "SELECT id, title, strftime(crawled_at, '%Y-%m-%d %H:%M:%S') AS crawled_at FROM articles ORDER BY articles.crawled_at DESC, id DESC LIMIT 10",
)
def _(spark, d):
    return reco.latest(standins.articles(spark, d).select("id", "title", "crawled_at"), "crawled_at", 10).withColumn("crawled_at", stamp("crawled_at"))


@query(
    "S9_archive_calendar",
    """WITH r AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders),
days AS (SELECT CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM r)
SELECT strftime(day, '%Y-%m-%d') AS day, CAST(page AS INTEGER) AS page, 'mode=LSD&mid=sec&sid1=101&date=' || strftime(day, '%Y%m%d') || '&page=' || page AS query
FROM days, range(1, 6) p(page)""",
)
def _(spark, d):
    span = standins.table(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    return article_scans.archive_calendar(span, article_scans.SECTIONS["economy"]).withColumn("day", day("day"))
