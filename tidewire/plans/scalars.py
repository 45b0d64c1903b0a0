"""Queries on the column functions: URLs, dates, names, markup, scores, model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import core, markup, signals, text, urls
from tidewire.operators.articles import MIN_EXTRACTED
from tidewire.operators import articles as ar
from tidewire.plans.articles import canon_sql
from tidewire.plans.registry import listed, query, stamp
from tidewire.plans.views import with_views
from tidewire.sources import standins

R = "CAST(round(CAST({} AS DECIMAL(38,10)), {}) AS DOUBLE)"
NOW = standins.ARTICLES_AS_OF


@query("X1_canonical_url_of_pages", f"SELECT page_id, {canon_sql('url')} AS canonical FROM pages")
def _(spark, d):
    return standins.table(spark, d, "pages").select("page_id", urls.canonical_url("url").alias("canonical"))


@query(
    "X1_canonical_url_of_articles",
    with_views("articles") + f", u AS (SELECT id, url || '?utm_x=1&sid=2&blank=&k=a+b%2Fc~*&ref=q#f/' AS u FROM articles) SELECT id, {canon_sql('u')} AS canonical FROM u",
)
def _(spark, d):
    a = standins.articles(spark, d)
    return a.select("id", urls.canonical_url(F.concat("url", F.lit("?utm_x=1&sid=2&blank=&k=a+b%2Fc~*&ref=q#f/"))).alias("canonical"))


@query(
    "X2_url_domain",
    """SELECT page_id, CASE WHEN contains(url, '://') THEN lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1)) ELSE 'default' END AS domain FROM pages""",
)
def _(spark, d):
    return standins.table(spark, d, "pages").select("page_id", urls.url_domain("url").alias("domain"))


# Raw date texts are built from order keys; the expected time is computed, not parsed.
_RAW_DATE = """CASE o_orderkey % 7
  WHEN 0 THEN strftime(t, '%Y.%m.%d / %H:%M') WHEN 1 THEN strftime(t, '등록일 %Y-%m-%d %H:%M') WHEN 2 THEN strftime(t, '%Y년 %m월 %d일 %H시 %M분')
  WHEN 3 THEN strftime(t, '%Y-%m-%dT%H:%M:%SZ') WHEN 4 THEN strftime(t, '%Y-13-%d') WHEN 5 THEN strftime(t, '%Y%m%dT%H%M%S') ELSE strftime(t, '%Y/%m/%d') END"""


@query(
    "X3_parse_flexible_date",
    """WITH o AS (SELECT o_orderkey, o_orderdate + to_minutes(o_orderkey % 1440) AS t FROM orders)
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 4 THEN NULL WHEN o_orderkey % 7 IN (2, 6) THEN strftime(date_trunc('day', t), '%Y-%m-%d %H:%M:%S')
  ELSE strftime(t, '%Y-%m-%d %H:%M:%S') END AS parsed FROM o""",
)
def _(spark, d):
    o = standins.table(spark, d, "orders")
    t = F.timestamp_add("MINUTE", F.col("o_orderkey") % 1440, F.col("o_orderdate"))
    raw = standins._choose(
        F.col("o_orderkey") % 7,
        F.date_format(t, "yyyy.MM.dd / HH:mm"),
        F.concat(F.lit("등록일 "), F.date_format(t, "yyyy-MM-dd HH:mm")),
        F.concat(F.date_format(t, "yyyy"), F.lit("년 "), F.date_format(t, "MM"), F.lit("월 "), F.date_format(t, "dd"), F.lit("일 "), F.date_format(t, "HH"), F.lit("시 30분")),
        F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit("T"), F.date_format(t, "HH:mm:ss"), F.lit("Z")),
        F.concat(F.date_format(t, "yyyy"), F.lit("-13-"), F.date_format(t, "dd")),
        F.concat(F.date_format(t, "yyyyMMdd"), F.lit("T"), F.date_format(t, "HHmmss")),
        F.date_format(t, "yyyy/MM/dd"),
    )
    return o.select(F.col("o_orderkey").alias("id"), stamp(text.parse_flexible_date(raw)).alias("parsed"))


@query("X4_collapse_repeat", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_name ELSE c_name || 'x' || c_custkey END AS name FROM customer")
def _(spark, d):
    c = standins.table(spark, d, "customer")
    name = F.col("c_name")
    raw = standins._choose(
        F.col("c_custkey") % 3, F.concat(name, name), F.concat(F.lit("작성자 : "), name, F.lit(" 님")), F.concat(name, F.lit("x"), F.col("c_custkey").cast("string"), F.lit("메모 12 입력 안내"))
    )
    return c.select(F.col("c_custkey").alias("id"), text.collapse_repeat(raw).alias("name"))


@query("X5_clean_title", "SELECT p_partkey AS id, p_name || ' by ' || p_brand || 'x' AS title FROM part")
def _(spark, d):
    p = standins.table(spark, d, "part")
    raw = F.concat("p_name", F.lit("   by \t"), "p_brand", F.lit("x  ["), F.col("p_size").cast("string"), F.lit("] "))
    return p.select(F.col("p_partkey").alias("id"), text.clean_title(raw).alias("title"))


@query("X6_parse_views", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey * 1000 WHEN 1 THEN o_orderkey % 9 ELSE NULL END AS views FROM orders")
def _(spark, d):
    o = standins.table(spark, d, "orders")
    key = F.col("o_orderkey")
    comma = F.format_number(key * 1000, 0)
    raw = (
        F.when(key % 3 == 0, F.array(F.lit("작성"), F.concat(F.lit("조회 수 "), comma)))
        .when(key % 3 == 1, F.array(F.lit("1234567890123"), F.concat(F.lit("hit: "), (key % 9).cast("string"))))
        .otherwise(F.array(F.lit("none"), F.lit("")))
    )
    return o.select(key.alias("id"), text.parse_views(raw).alias("views"))


@query(
    "X9_ellipsis",
    "SELECT doc_id AS id, CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '...' ELSE text END AS short, CASE WHEN length(text) > 250 THEN substring(text, 1, 250) || '...' ELSE text END AS longer FROM documents",
)
def _(spark, d):
    return standins.table(spark, d, "documents").select(F.col("doc_id").alias("id"), core.ellipsis("text", 120).alias("short"), core.ellipsis("text", 250).alias("longer"))


@query(
    "X10_local_labels",
    """SELECT event_id AS id, strftime(ts + INTERVAL 9 HOURS, '%H:%M') AS hm, strftime(ts + INTERVAL 9 HOURS, '%H:%M:%S') AS hms, strftime(ts + INTERVAL 9 HOURS, '%H:00') AS h,
  strftime(ts + INTERVAL 9 HOURS, '%m-%d') AS md, strftime(ts + INTERVAL 9 HOURS, '%m-%d %H:%M') AS mdhm FROM events""",
)
def _(spark, d):
    e = standins.table(spark, d, "events")
    forms = {"hm": "HH:mm", "hms": "HH:mm:ss", "h": "HH:00", "md": "MM-dd", "mdhm": "MM-dd HH:mm"}
    return e.select(F.col("event_id").alias("id"), *[core.local_label("ts", f).alias(n) for n, f in forms.items()])


@query("X11_bucket_index", "SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, (CAST(floor(epoch(ts)) AS BIGINT) - 1704067200) // 1800 AS bucket FROM events")
def _(spark, d):
    e = standins.table(spark, d, "events").select(F.col("event_id").alias("id"), core.epoch_seconds("ts").alias("epoch"))
    return e.withColumn("bucket", core.bucket_index("epoch", 1704067200, 1800))


@query(
    "X12_board_and_post",
    "SELECT doc_id AS id, CASE doc_id % 3 WHEN 2 THEN lang ELSE source END AS board, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS VARCHAR) ELSE 'recent' END AS post_id FROM documents",
)
def _(spark, d):
    doc = standins.table(spark, d, "documents")
    key = F.col("doc_id").cast("string")
    url = standins._choose(
        F.col("doc_id") % 3,
        F.concat(F.lit("https://www.reddit.com/r/"), "source", F.lit("/comments/"), key, F.lit("/some_title/")),
        F.concat(F.lit("https://www.reddit.com/r/"), "source", F.lit("/hot")),
        F.concat(F.lit("https://example.com/"), key),
    )
    return doc.select(F.col("doc_id").alias("id"), urls.board_and_post(url, F.concat(F.lit("r/"), "lang")).alias("b")).select("id", "b.board", "b.post_id")


@query(
    "X13_strip_tags",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages""",
)
def _(spark, d):
    return standins.table(spark, d, "pages").select("page_id", markup.strip_tags("html").alias("body"))


@query(
    "X14_json_access",
    with_views("articles")
    + """SELECT id, metadata->>'$.nlp_error' AS error, coalesce(CAST(metadata->>'$.nlp_processed' AS BOOLEAN), false) AS done, CAST(coalesce(json_array_length(metadata->'$.images'), 0) AS BIGINT) AS images FROM articles""",
)
def _(spark, d):
    return standins.articles(spark, d).select(
        "id", core.json_text("metadata", "nlp_error").alias("error"), core.json_flag("metadata", "nlp_processed").alias("done"), core.json_length("metadata", "images").cast("long").alias("images")
    )


@query(
    "X15_selector_clean",
    "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'div.' || p_type WHEN 4 THEN p_name ELSE '' END AS selector FROM part",
)
def _(spark, d):
    p = standins.table(spark, d, "part")
    raw = standins._choose(
        F.col("p_partkey") % 5,
        F.concat(F.lit(" `div."), "p_type", F.lit("`\n")),
        F.concat(F.lit("/* "), "p_name", F.lit(" */")),
        F.concat(F.lit("The "), "p_name", F.lit(" is the best selector because it contains every part")),
        F.concat(F.lit("div\n"), "p_name"),
        F.concat(F.lit('"'), "p_name", F.lit('"')),
    )
    return p.select(F.col("p_partkey").alias("id"), markup.selector_clean(raw).alias("selector"))


IMAGES_SQL = with_views("articles") + """, i AS (SELECT id, CAST(metadata->'$.images' AS VARCHAR[]) AS images FROM articles WHERE metadata IS NOT NULL)
"""


@query(
    "X16_image_tokens",
    IMAGES_SQL
    + """, f AS (SELECT id, list_filter(images, lambda u: NOT contains(lower(u), 'icon')) AS kept FROM i)
SELECT id, coalesce(array_to_string(list_transform(kept, lambda u, n: '{{IMG:' || n || ':' || u || '}}'), '|'), '') AS tokens FROM f""",
)
def _(spark, d):
    a = standins.articles(spark, d).where(F.col("metadata").isNotNull())
    images = F.coalesce(F.from_json(core.json_text("metadata", "images"), "array<string>"), F.array().cast("array<string>"))
    tokens = F.transform(markup.image_tokens(images), lambda t: t["token"])
    return a.select("id", listed(tokens).alias("tokens"))


@query(
    "U3_union_images",
    with_views("articles")
    + """SELECT id, CASE id % 5 WHEN 2 THEN 'https://img.example.com/a' || id || '.png|x' WHEN 3 THEN 'https://img.example.com/b' || id || '.png|https://img.example.com/icon.png|x'
  ELSE 'https://img.example.com/b' || id || '.png|x' END AS images FROM articles""",
)
def _(spark, d):
    a = standins.articles(spark, d)
    key = F.col("id").cast("string")
    second = F.array(F.concat(F.lit("https://img.example.com/"), F.when(F.col("id") % 5 == 2, "a").otherwise("b"), key, F.lit(".png")), F.lit("x"), F.lit("x"))
    return a.select("id", listed(markup.union_images(F.from_json(core.json_text("metadata", "images"), "array<string>"), second)).alias("images"))


@query(
    "X17_image_author",
    """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '@' || lower(p_type) || p_partkey ELSE '@user_' || substring(md5(CASE p_partkey % 3 WHEN 1 THEN 'https://img.example.com/a/icon' || p_partkey || '.gif?x=1'
  ELSE 'https://img.example.com/' || (p_partkey % 90) || '.png' END), 1, 6) END AS author FROM part""",
)
def _(spark, d):
    p = standins.table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    src = standins._choose(
        F.col("p_partkey") % 3,
        F.concat(F.lit("https://img.example.com/a/"), F.lower("p_type"), key, F.lit(".png?size=1")),
        F.concat(F.lit("https://img.example.com/a/icon"), key, F.lit(".gif?x=1")),
        F.concat(F.lit("https://img.example.com/"), (F.col("p_partkey") % 90).cast("string"), F.lit(".png")),
    )
    return p.select(F.col("p_partkey").alias("id"), markup.image_author(src).alias("author"))


@query(
    "X18_round_half_up",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R.format('l_extendedprice * l_discount', 2)} AS cut, {R.format('l_quantity / 7.0::DOUBLE', 3)} AS third FROM lineitem",
)
def _(spark, d):
    return standins.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", core.round_half_up(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("cut"),
        core.round_half_up(F.col("l_quantity") / 7.0, 3).alias("third"),
    )


def _has(word: str, col: str = "low") -> str:
    return f"CASE WHEN contains({col}, '{word.lower()}') THEN 1 ELSE 0 END"


_SUMS = ", ".join(f"{' + '.join(_has(w) for w in ws)} AS {g}" for g, ws in signals.SIGNAL_KEYWORDS.items())
_LIST = ", ".join(f"CASE WHEN contains(low, '{w.lower()}') THEN '{w}' END" for ws in signals.SIGNAL_KEYWORDS.values() for w in ws)
SIGNAL_SQL = with_views("articles") + f""", l AS (SELECT id, lower(title || ' ' || content) AS low FROM articles),
h AS (SELECT id, {_SUMS}, {' + '.join(_has(w) for w in signals.BULLISH_WORDS)} AS bull, {' + '.join(_has(w) for w in signals.BEARISH_WORDS)} AS bear,
  concat_ws('|', {_LIST}) AS signals FROM l),
s AS (SELECT id, signals, CASE WHEN CRITICAL > 0 THEN 'CRITICAL' WHEN EARNINGS + MACRO > 0 THEN 'HIGH' ELSE 'NORMAL' END AS signal_level,
  least(100, greatest(10, 50 + 15 * CRITICAL + 8 * EARNINGS + 8 * MACRO + 5 * TECH_AI + CASE WHEN bull = bear THEN 0 ELSE least(15, 5 * greatest(bull, bear)) END)) AS impact_score,
  CASE WHEN bull > bear THEN 'BULLISH' WHEN bear > bull THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment FROM h)
"""


def _signals(spark, d):
    a = standins.articles(spark, d)
    return a.select("id", signals.market_signal("title", "content").alias("s")).select("id", listed("s.signals").alias("signals"), "s.signal_level", "s.impact_score", "s.sentiment")


@query("M1_market_signal", SIGNAL_SQL + "SELECT * FROM s")
def _(spark, d):
    return _signals(spark, d)


@query("M2_impact_to_sentiment", SIGNAL_SQL + "SELECT id, (CAST(impact_score AS DOUBLE) - 50) / 50.0::DOUBLE AS score FROM s")
def _(spark, d):
    return _signals(spark, d).select("id", signals.impact_to_sentiment("impact_score").alias("score"))


POSTS_SQL = f"""WITH p AS (SELECT doc_id AS id, n_chars % 500 AS points, doc_id % 50 AS replies,
  date_diff('microsecond', TIMESTAMP '2025-12-31 00:00:00' + to_minutes(doc_id * 7), TIMESTAMP '{NOW}') / 1000000.0::DOUBLE / 3600.0::DOUBLE AS hours FROM documents)
"""


def _posts(spark, d):
    doc = standins.table(spark, d, "documents")
    at = core.from_epoch(F.lit(standins.ARTICLES_START_EPOCH) + F.col("doc_id") * 420)
    return doc.select(
        F.col("doc_id").alias("id"), (F.col("n_chars") % 500).alias("points"), (F.col("doc_id") % 50).alias("replies"),
        (core.seconds_between(at, core.ts_literal(NOW)) / 3600.0).alias("hours"),
    )


def _velocity_sql(weight, floor, limit, hours="hours"):
    v = f"((CAST(points AS DOUBLE) + CAST(replies AS DOUBLE) * {weight}::DOUBLE) / greatest({floor}::DOUBLE, {hours}))"
    return f"SELECT id, {R.format(v, 2)} AS velocity_score, {v} > {limit} AS is_spike, {R.format(f'greatest({floor}::DOUBLE, {hours})', 1)} AS hours_alive FROM p"


@query("M3_post_velocity", POSTS_SQL + _velocity_sql(2.5, 0.2, 75.0))
def _(spark, d):
    return _posts(spark, d).select("id", signals.post_velocity("points", "replies", "hours").alias("v")).select("id", "v.*")


@query("M4_thread_velocity", POSTS_SQL + _velocity_sql(3.5, 0.4, 120.0, "CASE WHEN id % 10 = 0 THEN 1.0::DOUBLE ELSE hours END"))
def _(spark, d):
    age = F.when(F.col("id") % 10 != 0, F.col("hours"))
    return _posts(spark, d).select("id", signals.thread_velocity("points", "replies", age).alias("v")).select("id", "v.*")


@query("T5_top_velocity", POSTS_SQL + ", v AS (" + _velocity_sql(2.5, 0.2, 75.0) + ") SELECT id, velocity_score FROM v ORDER BY velocity_score DESC, id LIMIT 15")
def _(spark, d):
    scored = _posts(spark, d).select("id", signals.post_velocity("points", "replies", "hours")["velocity_score"].alias("velocity_score"))
    return scored.orderBy(F.desc("velocity_score"), "id").limit(15)


def _tickers_sql(letters: str, symbols, limit: int) -> str:
    before, after = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
    known = ", ".join(f"CASE WHEN regexp_matches(upper(body), '{before}{s}{after}') THEN '{s}' END" for s in symbols)
    # RE2 has no look-ahead: a symbol is read with the character after it, and every "$" starts a new piece
    return rf"""SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_concat(
  list_transform(string_split(body, '$')[2:], lambda s: upper(nullif(regexp_extract(s, '^([{letters}]{{2,6}})(?:[^\p{{L}}\p{{N}}_]|$)', 1), ''))), [{known}]), lambda x: x IS NOT NULL)))[1:{limit}], '|') AS tickers FROM b"""


_TAIL = "content || ' $tsla, $A $nvda7 buy amd.' || CASE id % 3 WHEN 0 THEN ' $toolongname btc ETH' ELSE ' gme_x' END"


def _with_tail(spark, d):
    tail = F.when(F.col("id") % 3 == 0, " $toolongname btc ETH").otherwise(" gme_x")
    return standins.articles(spark, d).select("id", F.concat("content", F.lit(" $tsla, $A $nvda7 buy amd."), tail).alias("body"))


@query("M5_extract_tickers_forum", with_views("articles") + f", b AS (SELECT id, {_TAIL} AS body FROM articles) " + _tickers_sql("A-Za-z", signals.FORUM_SYMBOLS, 8))
def _(spark, d):
    return _with_tail(spark, d).select("id", listed(signals.extract_tickers("body")).alias("tickers"))


@query("M5_extract_tickers_thread", with_views("articles") + f", b AS (SELECT id, {_TAIL} AS body FROM articles) " + _tickers_sql("A-Za-z0-9", signals.THREAD_SYMBOLS, 6))
def _(spark, d):
    return _with_tail(spark, d).select("id", listed(signals.extract_tickers("body", "thread")).alias("tickers"))


@query(
    "M14_article_stats",
    with_views("articles")
    + """SELECT id, length(content) AS char_count, greatest(1, CAST(round(CAST(length(content) AS DECIMAL(20,4)) / 500) AS INTEGER)) AS reading_minutes,
  CAST(round(CAST(strlen(content) / 1024.0::DOUBLE AS DECIMAL(38,10)), 1) AS DOUBLE) AS html_kb, CASE WHEN length(content) > 300 THEN substring(content, 1, 300) || '...' ELSE content END AS preview,
  CASE WHEN coalesce(summary, '') = '' THEN CASE WHEN length(content) > 300 THEN substring(content, 1, 300) || '...' ELSE content END ELSE summary END AS summary FROM articles""",
)
def _(spark, d):
    return standins.articles(spark, d).select("id", signals.article_stats("content", "content", "summary").alias("s")).select("id", "s.*")


@query(
    "M15_extractive_summary",
    with_views("articles")
    + r""", l AS (SELECT id, title, list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 15) AS lines FROM articles)
SELECT id, CASE WHEN len(lines) > 0 THEN array_to_string(list_transform(lines[1:3], lambda x, i: i || '. ' || x), chr(10)) ELSE title END AS summary,
  array_to_string(list_filter(regexp_extract_all(title, '[가-힣a-zA-Z0-9]{2,}'), lambda w: w NOT IN ('시사', '스페셜', '단독', '종합', '속보', '뉴스', '기자', '게시판'))[1:5], '|') AS topics FROM l""",
)
def _(spark, d):
    a = standins.articles(spark, d)
    return a.select("id", text.extractive_summary("content", "title").alias("summary"), listed(text.headline_topics("title")).alias("topics"))


@query(
    "M16_parse_model_output",
    with_views("articles")
    + r"""SELECT id, id % 4 <> 2 AS parsed, CASE WHEN id % 4 = 2 THEN regexp_replace(substring('plain ' || category, 1, 300), '^\s+|\s+$', '', 'g') WHEN id % 4 = 3 THEN 's' || id ELSE coalesce(nullif(title, ''), 'empty') END AS summary,
  CASE WHEN id % 4 = 0 THEN CAST(id % 7 AS DOUBLE) / 4 WHEN id % 4 = 1 THEN 0.0::DOUBLE WHEN id % 4 = 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS sentiment_score,
  CASE WHEN id % 4 = 0 THEN category ELSE '중립' END AS sentiment_label, CASE WHEN id % 4 = 0 THEN 'a|' || category ELSE '' END AS key_topics FROM articles""",
)
def _(spark, d):
    a = standins.articles(spark, d)
    key = F.col("id")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("empty"))
    full = F.to_json(
        F.struct(title.alias("summary"), ((key % 7).cast("double") / 4).alias("sentiment_score"), F.col("category").alias("sentiment_label"), F.array(F.lit("a"), "category").alias("key_topics"))
    )
    bare = F.to_json(F.struct(title.alias("summary"), F.lit("not a number").alias("sentiment_score"), F.col("category").alias("key_topics")))
    short = F.concat(F.lit('{"summary":"s'), key.cast("string"), F.lit('","sentiment_score":0.5,"key_topics":"none"}'))
    raw = standins._choose(
        key % 4,
        F.concat(F.lit("<think>a {b}\nc</think>\n```json\n"), full, F.lit("\n```")),
        F.concat(F.lit("Here it is: "), bare, F.lit(" done")),
        F.concat(F.lit("plain "), "category"),
        short,
    )
    m = a.select("id", markup.parse_model_output(raw).alias("m"))
    return m.select("id", "m.parsed", "m.summary", "m.sentiment_score", "m.sentiment_label", listed("m.key_topics").alias("key_topics"))


@query("F13_extraction_gate", f"SELECT doc_id AS id FROM documents WHERE length(text) >= {MIN_EXTRACTED}")
def _(spark, d):
    return ar.keep_content(standins.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "text", MIN_EXTRACTED).select("id")
