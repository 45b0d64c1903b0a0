"""Column functions on hand-made edge rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewire.functions import core, markup, signals, text, urls


def one(spark, column, **values):
    """The value of a column expression over one row."""
    row = spark.range(1).select(*[(v if hasattr(v, "_jc") or type(v).__name__ == "Column" else F.lit(v)).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("https://a.com/x/?utm_source=1&id=2#frag", "https://a.com/x/?id=2"),
        ("https://a.com/x/?utm_source=1", "https://a.com/x"),
        ("https://a.com/x?ref=1&sid=2&fbclid=3&source=4&rc=5&_gl=6", "https://a.com/x"),
        ("https://a.com/x?blank=&k", "https://a.com/x"),
        ("HTTPS://A.com/X///", "https://A.com/X"),
        ("https://a.com/?q=a%20b+c~*&r=%ED%95%9C", "https://a.com/?q=a+b+c~%2A&r=%ED%95%9C"),
        ("https://a.com/x;p=1?a=1=2", "https://a.com/x;p=1?a=1%3D2"),
        ("", ""),
        (None, ""),
    ],
)
def test_canonical_url(spark, raw, want):
    got = one(spark, urls.canonical_url("u"), u=F.lit(raw).cast("string"))
    assert got == want
    assert one(spark, urls.canonical_url("u"), u=got) == want  # idempotent


@pytest.mark.parametrize("raw, want", [("https://WWW.A.com:80/x", "www.a.com:80"), ("//b.org", "b.org"), ("nothing", "default"), (None, "default")])
def test_url_domain(spark, raw, want):
    assert one(spark, urls.url_domain("u"), u=F.lit(raw).cast("string")) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2026.08.18 / 22:46", dt.datetime(2026, 8, 18, 22, 46)),
        ("2026-08-18 22:46:07", dt.datetime(2026, 8, 18, 22, 46, 7)),
        ("2026/8/1 2:03", dt.datetime(2026, 8, 1, 2, 3)),
        ("2026년 08월 18일 22시 46분", dt.datetime(2026, 8, 18)),
        ("등록일 2026-08-17 20:21", dt.datetime(2026, 8, 17, 20, 21)),
        ("2026-08-17T20:21:22Z", dt.datetime(2026, 8, 17, 20, 21, 22)),
        ("20260817T202122", dt.datetime(2026, 8, 17, 20, 21, 22)),
        ("2026-13-01", None),
        ("", None),
        (None, None),
    ],
)
def test_flexible_date(spark, raw, want):
    assert one(spark, text.parse_flexible_date("d"), d=F.lit(raw).cast("string")) == want


@pytest.mark.parametrize(
    "raw, want", [("abcabc", "abc"), ("aa", "a"), ("aba", "aba"), ("abababab", "ab"), ("작성자 : kim 님", "kim"), ("kim메모 12 입력 x", "kim"), (None, "")]
)
def test_collapse_repeat(spark, raw, want):
    assert one(spark, text.collapse_repeat("n"), n=F.lit(raw).cast("string")) == want


def test_views_and_titles(spark):
    assert one(spark, text.parse_views(F.array(F.lit("조회 수 1,234"), F.lit("9")))) == 1234
    assert one(spark, text.parse_views(F.array(F.lit("123456789")))) == 123456789
    assert one(spark, text.clean_title(F.lit("A  b \n c [12] "))) == "A b c"


def test_market_signal(spark):
    got = one(spark, signals.market_signal(F.lit("Surge in NVIDIA earnings"), F.lit("Fed rally; record high")))
    assert got["signals"] == ["Surge", "Earnings", "NVIDIA", "Fed"]
    assert (got["signal_level"], got["impact_score"], got["sentiment"]) == ("CRITICAL", 100, "BULLISH")
    flat = one(spark, signals.market_signal(F.lit("nothing"), F.lit(None).cast("string")))
    assert (flat["signals"], flat["signal_level"], flat["impact_score"], flat["sentiment"]) == ([], "NORMAL", 50, "NEUTRAL")
    even = one(spark, signals.market_signal(F.lit("beat and miss"), F.lit("")))
    assert (even["sentiment"], even["impact_score"], even["signal_level"]) == ("NEUTRAL", 66, "HIGH")


def test_velocity_edges(spark):
    at_limit = one(spark, signals.post_velocity(F.lit(75), F.lit(0), F.lit(1.0)))
    assert (at_limit["velocity_score"], at_limit["is_spike"]) == (75.0, False)
    young = one(spark, signals.post_velocity(F.lit(20), F.lit(0), F.lit(0.01)))
    assert (young["velocity_score"], young["is_spike"], young["hours_alive"]) == (100.0, True, 0.2)
    unknown = one(spark, signals.thread_velocity(F.lit(121), F.lit(0), F.lit(None).cast("double")))
    assert (unknown["velocity_score"], unknown["is_spike"], unknown["hours_alive"]) == (121.0, True, 1.0)


def test_tickers(spark):
    assert one(spark, signals.extract_tickers(F.lit("$tsla $A btc, 삼성TSLA éAMD $toolongx"))) == ["BTC", "TSLA"]
    assert one(spark, signals.extract_tickers(F.lit("BTC ETH SOL NVDA TSLA AAPL AMD MSFT AMZN"))) == ["AAPL", "AMD", "AMZN", "BTC", "ETH", "MSFT", "NVDA", "SOL"]
    assert one(spark, signals.extract_tickers(F.lit("$nvda7 ai 005930"), "thread")) == ["005930", "AI", "NVDA7"]


@pytest.mark.parametrize(
    "raw, parsed, summary, topics",
    [
        ('<think>{"summary":"no"}</think>{"summary":"s","key_topics":["a","b"]}', True, "s", ["a", "b"]),
        ('```json\n{"summary":"s","sentiment_score":"0.25"}\n```', True, "s", []),
        ('text {"summary":"s","key_topics":"a"} text', True, "s", []),
        ("no json", False, "no json", []),
        ('{"summary": broken', False, '{"summary": broken', []),
        (None, False, "", []),
    ],
)
def test_model_output(spark, raw, parsed, summary, topics):
    got = one(spark, markup.parse_model_output("m"), m=F.lit(raw).cast("string"))
    assert (got["parsed"], got["summary"], got["key_topics"]) == (parsed, summary, topics)


@pytest.mark.parametrize(
    "raw, want",
    [("`div.a > b`", "div.a > b"), ("/* none */", ""), ("Selector cannot be found", ""), ("a\nb", ""), ("a b c d e f g the h", ""), (None, "")],
)
def test_selector_clean(spark, raw, want):
    assert one(spark, markup.selector_clean("s"), s=F.lit(raw).cast("string")) == want


def test_tokens_keep_repeats_and_drop_stop_words(spark):
    got = one(spark, text.tokenize(F.lit("HBM 뉴스 HBM a 삼성전자! x1"), stopwords=["x1"]))
    assert got == ["HBM", "HBM", "삼성전자"]


def test_small_helpers(spark):
    assert one(spark, core.ellipsis(F.lit("abcd"), 3)) == "abc..." and one(spark, core.ellipsis(F.lit("abc"), 3)) == "abc"
    assert one(spark, core.round_half_up(F.lit(1.005), 2)) == 1.01
    assert one(spark, core.local_label(core.ts_literal("2025-12-31 15:00:00"), "MM-dd HH:mm")) == "01-01 00:00"
    assert one(spark, core.json_flag(F.lit('{"a":null}'), "a")) is False and one(spark, core.json_length(F.lit("{}"), "a")) == 0
    assert one(spark, core.epoch_seconds(core.ts_literal("1969-12-31 23:59:59.500000"))) == -1
    assert one(spark, markup.strip_tags(F.lit("<p>a<script>x</script>&nbsp;<b>b</b>"))) == "a &nbsp; b"
    stats = one(spark, signals.article_stats(F.lit("x" * 750), F.lit("y" * 2048), F.lit(None).cast("string")))
    assert (stats["reading_minutes"], stats["html_kb"], len(stats["preview"])) == (2, 2.0, 303)
