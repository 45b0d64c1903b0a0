"""Scores of headlines, posts and article statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.core import ColumnLike, as_col, ellipsis, full_text, let, round_half_up

# Market keyword groups and the points one hit adds.
SIGNAL_KEYWORDS = {
    "CRITICAL": (
        "Surge", "Plunge", "Crash", "Emergency", "Rate Cut", "Rate Hike", "Default", "Recession", "War", "Tariff",
        "Sanction", "급등", "폭락", "비상", "금리인하", "금리인상", "파산", "제재", "관세",
    ),
    "EARNINGS": ("Earnings", "Revenue", "Guidance", "Beat", "Miss", "Forecast", "실적", "어닝", "매출", "영업이익", "상향", "하향"),
    "TECH_AI": (
        "NVIDIA", "Apple", "Microsoft", "Tesla", "Alphabet", "Meta", "Amazon", "OpenAI", "Semiconductor", "HBM",
        "AI Chip", "엔비디아", "테슬라", "애플", "반도체",
    ),
    "MACRO": (
        "Fed", "Powell", "CPI", "PPI", "Treasury", "Yield", "Inflation", "Jobs", "FOMC", "연준", "파월", "국채금리", "물가", "고용",
    ),
}
SIGNAL_POINTS = {"CRITICAL": 15, "EARNINGS": 8, "TECH_AI": 5, "MACRO": 8}
# Mood words.
BULLISH_WORDS = ("surge", "jump", "beat", "rally", "gain", "optimism", "record", "high", "상승", "급등", "호실적", "최고치")
BEARISH_WORDS = ("plunge", "drop", "miss", "crash", "fall", "fear", "loss", "tariff", "하락", "폭락", "부진", "우려")
# Well-known symbols of the two post sources.
FORUM_SYMBOLS = (
    "BTC", "ETH", "SOL", "NVDA", "TSLA", "AAPL", "AMD", "MSFT", "AMZN", "GOOGL", "META", "SPY", "QQQ", "GME", "PLTR",
    "MSTR", "SMCI", "AVGO", "MU",
)
THREAD_SYMBOLS = ("NVDA", "TSLA", "AAPL", "MSFT", "META", "GOOGL", "AMZN", "BTC", "ETH", "AI", "LLM", "HBM", "005930")
# Score bounds and defaults.
BASE_SCORE, MIN_SCORE, MAX_SCORE, MOOD_POINTS, MOOD_CAP = 50, 10, 100, 5, 15


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    """The words of a short fixed list that occur in a lower-cased text."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w.lower())), F.lit(w)) for w in words]))


def market_signal(title: ColumnLike, text: ColumnLike) -> Column:
    """Struct (signals, signal_level, impact_score, sentiment) of a headline and its summary.

    The text is lower-cased once and every word is looked for once.
    """
    low = F.lower(full_text(F.coalesce(as_col(title), F.lit("")), F.coalesce(as_col(text), F.lit(""))))
    groups = {**SIGNAL_KEYWORDS, "bull": BULLISH_WORDS, "bear": BEARISH_WORDS}
    found = let(low, lambda t: F.struct(*[_hits(t, words).alias(g) for g, words in groups.items()]))
    return let(found, _score)


def _score(found: Column) -> Column:
    counts = {g: F.size(found[g]) for g in (*SIGNAL_KEYWORDS, "bull", "bear")}
    bull, bear = counts["bull"], counts["bear"]
    points = F.lit(BASE_SCORE)
    for group, value in SIGNAL_POINTS.items():
        points = points + counts[group] * value
    mood = F.when(bull == bear, 0).otherwise(F.least(F.lit(MOOD_CAP), F.greatest(bull, bear) * MOOD_POINTS))
    level = (
        F.when(counts["CRITICAL"] > 0, "CRITICAL").when((counts["EARNINGS"] > 0) | (counts["MACRO"] > 0), "HIGH").otherwise("NORMAL")
    )
    return F.struct(
        F.concat(*[found[g] for g in SIGNAL_KEYWORDS]).alias("signals"),
        level.alias("signal_level"),
        F.least(F.lit(MAX_SCORE), F.greatest(F.lit(MIN_SCORE), points + mood)).alias("impact_score"),
        F.when(bull > bear, "BULLISH").when(bear > bull, "BEARISH").otherwise("NEUTRAL").alias("sentiment"),
    )


def impact_to_sentiment(impact: ColumnLike) -> Column:
    """Map a 0..100 impact to -1..1; a missing impact is neutral."""
    return (F.coalesce(as_col(impact).cast("double"), F.lit(float(BASE_SCORE))) - BASE_SCORE) / F.lit(50.0)


def _velocity(points: Column, replies: Column, weight: float, hours: Column, floor: float, limit: float) -> Column:
    alive = F.greatest(F.lit(floor), hours)
    velocity = (points.cast("double") + replies.cast("double") * weight) / alive
    return F.struct(
        round_half_up(velocity, 2).alias("velocity_score"),
        (velocity > limit).alias("is_spike"),
        round_half_up(alive, 1).alias("hours_alive"),
    )


def post_velocity(score: ColumnLike, comments: ColumnLike, hours: ColumnLike, multiplier: float = 1.5) -> Column:
    """Forum posts: points plus 2.5 per comment, per hour; at least 0.2 hours; spike above 50 x multiplier."""
    return _velocity(as_col(score), as_col(comments), 2.5, as_col(hours), 0.2, 50.0 * multiplier)


def thread_velocity(likes: ColumnLike, replies: ColumnLike, hours: ColumnLike) -> Column:
    """Thread posts: likes plus 3.5 per reply, per hour; at least 0.4 hours; unknown age is one hour; spike above 120."""
    return _velocity(as_col(likes), as_col(replies), 3.5, F.coalesce(as_col(hours), F.lit(1.0)), 0.4, 120.0)


def extract_tickers(text: ColumnLike, variant: str = "forum") -> Column:
    """Sorted symbols: "$"-prefixed ones and well-known ones written as a whole word, in two passes over the text.

    The word boundary is spelled out so that letters of every script count as word characters.
    """
    text = as_col(text)
    letters, symbols, limit = ("A-Za-z", FORUM_SYMBOLS, 8) if variant == "forum" else ("A-Za-z0-9", THREAD_SYMBOLS, 6)
    word = r"[\p{L}\p{N}_]"
    cash = F.regexp_extract_all(text, F.lit(rf"\$([{letters}]{{2,6}})(?!{word})"), F.lit(1))
    known = F.regexp_extract_all(text, F.lit(rf"(?i)(?<!{word})({'|'.join(symbols)})(?!{word})"), F.lit(1))
    return F.slice(F.sort_array(F.array_distinct(F.transform(F.concat(cash, known), F.upper))), 1, limit)


# Fixed value: the title that stands for none.
MISSING_TITLE = "제목 없음"


def rule_confidence(link_count: ColumnLike, content: ColumnLike, title: ColumnLike, missing_title: str = MISSING_TITLE) -> Column:
    """How far an extraction rule can be trusted, 0..1."""
    links, chars = as_col(link_count), F.length(F.coalesce(as_col(content), F.lit("")))
    title = F.coalesce(as_col(title), F.lit(""))
    tenths = (
        F.when(links >= 5, 4).when(links >= 1, 2).otherwise(0)
        + F.when(chars > 100, 4).when(chars > 20, 2).otherwise(0)
        + F.when((title != "") & (title != missing_title), 2).otherwise(0)
    )
    return F.least(F.lit(10), tenths).cast("double") / F.lit(10.0)


def article_stats(content: ColumnLike, html: ColumnLike, description: ColumnLike) -> Column:
    """Characters, reading minutes, page size in KB, preview and summary of an article."""
    content = F.coalesce(as_col(content), F.lit(""))
    chars = F.length(content)
    preview = ellipsis(content, 300)
    return F.struct(
        chars.alias("char_count"),
        F.greatest(F.lit(1), F.round(chars.cast("decimal(20,4)") / 500).cast("int")).alias("reading_minutes"),
        F.round(F.octet_length(as_col(html)).cast("decimal(20,4)") / 1024, 1).cast("double").alias("html_kb"),
        preview.alias("preview"),
        F.coalesce(F.nullif(as_col(description), F.lit("")), preview).alias("summary"),
    )
