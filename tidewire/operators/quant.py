"""Closing-price screening and next-session back-tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.core import round_half_up
from tidewire.operators.keys import top_per

# Thresholds of the screen and of the back-tests.
STRATEGY = "CLOSING_MOMENTUM_V1"
MIN_AMOUNT, AMOUNT_UNIT = 3e10, 1e11
MIN_CHANGE, MAX_CHANGE = 3.0, 18.0
TOP_PICKS = 5
SUCCESS_RETURN, SPEC_SUCCESS_RETURN = 1.5, 2.0
SURGE_SESSIONS, SURGE_FACTOR = 20, 2.0


def score_rank(scored: DataFrame, n: int = TOP_PICKS) -> DataFrame:
    """The best ``n`` rows of every day."""
    return top_per(scored, ["target_dt"], [F.desc("target_score"), F.asc("code")], n)


def closing_screen(snapshot: DataFrame, min_amount: float = MIN_AMOUNT, amount_unit: float = AMOUNT_UNIT, n: int = TOP_PICKS) -> DataFrame:
    """Picks of every day by traded amount and change (M6)."""
    score = F.col("amount") / amount_unit * 0.5 + F.col("change_ratio") * 0.5
    passed = snapshot.dropna(subset=["close", "volume", "amount"]).where(
        (F.col("amount") >= min_amount) & F.col("change_ratio").between(MIN_CHANGE, MAX_CHANGE)
    )
    scored = passed.select(
        "target_dt",
        F.col("code").cast("string").alias("code"),
        "name",
        F.lit(STRATEGY).alias("strategy_name"),
        score.alias("target_score"),
        F.col("close").cast("long").alias("closing_price"),
    )
    return score_rank(scored, n)


def volume_surge(bars: DataFrame, sessions: int = SURGE_SESSIONS, factor: float = SURGE_FACTOR) -> DataFrame:
    """Bars whose volume is at least ``factor`` times the mean of the sessions before (W4); all sessions are required.

    A code has one bar per day, so a code's window is as long as the calendar.
    """
    before = W.partitionBy("code").orderBy("target_dt").rowsBetween(-sessions, -1)
    mean = F.when(F.count("volume").over(before) == sessions, F.sum("volume").over(before).cast("double") / sessions)
    return (
        bars.withColumn("mean_volume", mean)
        .withColumn("surge", F.try_divide(F.col("volume").cast("double"), F.col("mean_volume")))
        .where(F.col("volume") >= F.col("mean_volume") * factor)
    )


def closing_screen_flow(
    bars: DataFrame, news: DataFrame, w_surge: float = 1.0, w_flow: float = 1.0, w_news: float = 1.0, n: int = TOP_PICKS
) -> DataFrame:
    """The documented screen (M6b): volume surge, both big buyer groups net long, change in range.

    ``news`` has code and mentions (momentum of the code in the day's articles), summed for a code that it names more than once; codes without news count zero.
    The weights are parameters.
    """
    change = (F.col("close_price") - F.col("open_price")).cast("double") / F.col("open_price") * 100.0
    passed = (
        volume_surge(bars)
        .withColumn("change_ratio", change)
        .where((F.col("foreigner") > 0) & (F.col("institution") > 0) & F.col("change_ratio").between(MIN_CHANGE, MAX_CHANGE))
    )
    flow = (F.col("foreigner") + F.col("institution")).cast("double")
    score = F.col("surge") * w_surge + flow * w_flow + F.coalesce("mentions", F.lit(0)).cast("double") * w_news
    scored = passed.join(news.groupBy("code").agg(F.sum("mentions").alias("mentions")), "code", "left").select(
        "target_dt", "code", "name", F.lit("CLOSING_FLOW").alias("strategy_name"), score.alias("target_score"), F.col("close_price").alias("closing_price")
    )
    return score_rank(scored, n)


def pending_targets(targets: DataFrame, today) -> DataFrame:
    """Picks that are not verified yet and whose day is over."""
    return targets.where(F.col("is_success").isNull() & (F.col("target_dt") < F.lit(today).cast("date")))


def next_session(targets: DataFrame, bars: DataFrame) -> DataFrame:
    """Add the second bar on or after ``target_dt`` of the same code (J4, W3); picks without one are dropped.

    Instead of a range join, the distinct (code, day) pairs of the picks are merged into the code's bars and looked up
    in one ordered pass. Both sides of that pass have one row per code and day. The picks themselves, however many per
    day, meet the result in an equality join that adaptive execution can split.
    """
    by_code = W.partitionBy("code").orderBy("target_dt")
    following = F.lead(F.struct(F.col("target_dt").alias("dt"), "open_price", "high_price", "close_price")).over(by_code)
    marked = bars.select("code", "target_dt", F.lit(1).alias("is_bar"), F.struct(following.alias("next")).alias("bar"))
    wanted = targets.select("code", "target_dt").distinct().select("code", "target_dt", F.lit(0).alias("is_bar"), F.lit(None).alias("bar"))
    from_here = W.partitionBy("code").orderBy(F.desc("target_dt"), F.desc("is_bar")).rowsBetween(W.unboundedPreceding, 0)
    found = (
        marked.unionByName(wanted)
        .withColumn("hit", F.last("bar", ignorenulls=True).over(from_here))
        .where((F.col("is_bar") == 0) & F.col("hit.next").isNotNull())
        .select("code", "target_dt", "hit.next.*")
    )
    return targets.join(
        found.select(
            "code", "target_dt", F.col("dt").alias("next_dt"), F.col("open_price").alias("next_day_open"),
            F.col("high_price").alias("next_day_10m_high"), F.col("close_price").alias("next_day_close"),
        ),
        ["code", "target_dt"],
    )


def _percent(value: Column, base: Column) -> Column:
    return F.try_divide((value - base).cast("double"), base.cast("double")) * 100.0


def backtest_returns(matched: DataFrame) -> DataFrame:
    """Returns of matched picks (M7). Success is judged on the unrounded high return."""
    to_open = _percent(F.col("next_day_open"), F.col("closing_price"))
    to_high = _percent(F.col("next_day_10m_high"), F.col("closing_price"))
    return matched.withColumns(
        {"return_rate_open": round_half_up(to_open, 2), "return_rate_high": round_half_up(to_high, 2), "is_success": to_high >= SUCCESS_RETURN}
    )


def backtest_returns_from_open(matched: DataFrame) -> DataFrame:
    """The documented variant (M7b): high against the next open, success from two percent."""
    to_high = _percent(F.col("next_day_10m_high"), F.col("next_day_open"))
    return matched.withColumns({"return_rate_high": round_half_up(to_high, 2), "is_success": to_high >= SPEC_SUCCESS_RETURN})


def quant_stats(targets: DataFrame) -> DataFrame:
    """Totals and win rate of all picks, verified or not (A6); zeros for an empty table."""
    total, wins = F.count("*"), F.count_if("is_success")

    def mean(c: str) -> Column:
        return F.coalesce(round_half_up(F.avg(F.col(c).cast("decimal(18,4)")), 2), F.lit(0.0))

    return targets.agg(
        total.alias("total_trades"),
        wins.alias("success_trades"),
        F.coalesce(round_half_up(F.try_divide(wins.cast("double"), total.cast("double")) * 100.0, 2), F.lit(0.0)).alias("win_rate"),
        mean("return_rate_open").alias("avg_return_rate_open"),
        mean("return_rate_high").alias("avg_return_rate_high"),
    )


def closing_targets(targets: DataFrame, target_dt=None, n: int = 20) -> DataFrame:
    """The newest, best picks, optionally of one day."""
    rows = targets if target_dt is None else targets.where(F.col("target_dt") == F.lit(target_dt).cast("date"))
    return rows.orderBy(F.desc("target_dt"), F.desc("target_score"), "code").limit(n)


def daily_bars(bars: DataFrame, code: str, n: int = 60) -> DataFrame:
    """The last ``n`` bars of a code in ascending order."""
    return bars.where(F.col("code") == code).orderBy(F.desc("target_dt")).limit(n).orderBy("target_dt")
