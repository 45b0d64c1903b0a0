"""Queries on feed, listing and embedded-post documents. Each source document becomes one feed document built from its lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.core import ts_literal
from tidewire.plans.registry import listed, query, stamp
from tidewire.sources import feeds, standins

NOW = standins.ARTICLES_AS_OF
LINES_SQL = r"""WITH l AS (SELECT doc_id, source, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[^\p{L}\p{N} .,]', '', 'g'))), lambda x: x <> '') AS lines FROM documents),
r AS (SELECT doc_id, source, lang, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM l)
"""


def _lines(spark, d, docs=None):
    """Documents (``docs``, else the whole table) with their non-empty lines, reduced to plain characters that need no escaping."""
    plain = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}\p{N} .,]", "")))
    docs = standins.table(spark, d, "documents") if docs is None else docs
    return docs.select("doc_id", "source", "lang", F.filter(plain, lambda x: x != "").alias("lines"))


def _joined(lines: Column, item) -> Column:
    return F.array_join(F.transform(lines, item), "")


def _feed_docs(spark, d):
    num = lambda i: i.cast("string")
    rss = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>t</title>'),
        _joined(
            F.col("lines"),
            lambda x, i: F.concat(
                F.lit("<item><title>"), x, F.lit("</title><link>https://n.example.com/"), num(i), F.lit("</link><pubDate>Mon, 01 Jan 2024 10:"), F.lpad(num(i % 60), 2, "0"),
                F.lit(":00 +0100</pubDate><description>&lt;p&gt;"), x, F.lit("&lt;/p&gt;</description>"),
                F.when(i % 2 == 0, F.concat(F.lit('<source url="https://s.example.com">'), F.col("source"), F.lit("</source>"))).otherwise(""), F.lit("</item>"),
            ),
        ),
        F.lit("</channel></rss>"),
    )
    atom = F.concat(
        F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>'),
        _joined(
            F.col("lines"),
            lambda x, i: F.when(i == 1, "<entry><summary>no title and no link</summary></entry>").otherwise(
                F.concat(
                    F.lit("<entry><title>"), x, F.lit("</title>"), F.when(i % 2 == 0, F.concat(F.lit('<link href="https://a.example.com/'), num(i), F.lit('"/>'))).otherwise(""),
                    F.lit("<summary>"), x, F.lit("</summary></entry>"),
                )
            ),
        ),
        F.lit("</feed>"),
    )
    return _lines(spark, d).select(
        F.concat(F.lit("feed/"), F.col("doc_id").cast("string")).alias("feed_url"), F.when(F.col("lang") == "de", atom).otherwise(rss).alias("body"), ts_literal(NOW).alias("as_of")
    )


_SUMMARY = "CASE WHEN length(line) > 250 THEN substring(line, 1, 250) || '...' ELSE line END"
RSS_SQL = f"""SELECT 'feed/' || doc_id AS feed_url, CAST(pos AS INTEGER) AS pos, line AS title, 'https://n.example.com/' || pos AS url,
  CASE WHEN pos % 2 = 0 THEN source ELSE 'Global Financial Wire' END AS publisher, strftime(TIMESTAMP '2024-01-01 09:00:00' + to_minutes(pos % 60), '%Y-%m-%d %H:%M:%S') AS published_at,
  regexp_replace({_SUMMARY}, ' +', ' ', 'g') AS summary FROM r WHERE lang <> 'de' AND pos < 15"""
ATOM_SQL = f"""SELECT 'feed/' || doc_id AS feed_url, CAST(pos AS INTEGER) AS pos, line AS title, CASE WHEN pos % 2 = 0 THEN 'https://a.example.com/' || pos ELSE 'feed/' || doc_id END AS url,
  'Target Feed' AS publisher, '{NOW}' AS published_at, regexp_replace({_SUMMARY}, ' +', ' ', 'g') AS summary FROM r WHERE lang = 'de' AND pos < 15 AND pos <> 1"""
# strip_tags squeezes blanks before the cut, so the lines are squeezed first here, too
_SQUEEZED = LINES_SQL.replace("unnest(lines) AS line", "regexp_replace(unnest(lines), ' +', ' ', 'g') AS line")


@query("S3_feed_items", _SQUEEZED + RSS_SQL)
def _(spark, d):
    return _tidy(feeds.feed_items(_feed_docs(spark, d)))


@query("S4_feed_entries", _SQUEEZED + ATOM_SQL)
def _(spark, d):
    docs = _feed_docs(spark, d)
    return _tidy(feeds.feed_rows(docs).where(F.col("publisher") == feeds.ATOM_PUBLISHER))


@query("S4_feed_rows", _SQUEEZED + RSS_SQL + " UNION ALL " + ATOM_SQL)
def _(spark, d):
    return _tidy(feeds.feed_rows(_feed_docs(spark, d)))


def _tidy(rows):
    return rows.withColumns({"published_at": stamp("published_at"), "title": F.regexp_replace("title", " +", " ")})


def _listing(spark, d):
    child = lambda x, i: F.struct(
        F.struct(
            x.alias("title"), F.concat(F.lit("/r/x/"), i.cast("string")).alias("permalink"), (i * 40).alias("score"), F.when(i % 3 != 0, i * 7).alias("num_comments"), x.alias("selftext"),
            (i == 2).alias("stickied"), (F.lit(float(1767355200)) - i * 1800).alias("created_utc"), F.lit("").alias("link_flair_text"),
        ).alias("data")
    )
    body = F.to_json(F.struct(F.struct(F.transform("lines", child).alias("children")).alias("data")))
    return _lines(spark, d).select(F.col("source").alias("board"), F.col("doc_id").cast("string").alias("doc"), body.alias("body"), ts_literal(NOW).alias("as_of"))


@query(
    "S5_listing_posts",
    LINES_SQL
    + """, p AS (SELECT *, (CAST(pos * 40 AS DOUBLE) + CASE WHEN pos % 3 <> 0 THEN pos * 7 ELSE 0 END * 2.5::DOUBLE) / greatest(0.2::DOUBLE, pos / 2.0::DOUBLE) AS v FROM r WHERE pos <> 2)
SELECT 'r/' || source AS board, CAST(pos AS INTEGER) AS pos, line AS title, 'https://www.reddit.com/r/x/' || pos AS url, 'u/unknown' AS author, pos * 40 AS score,
  CASE WHEN pos % 3 <> 0 THEN pos * 7 ELSE 0 END AS num_comments, CAST(round(CAST(v AS DECIMAL(38,10)), 2) AS DOUBLE) AS velocity_score, v > 75 AS is_spike,
  CASE WHEN length(line) > 220 THEN substring(line, 1, 220) || '...' ELSE line END AS summary, 'Discussion' AS flair,
  strftime(TIMESTAMP '2026-01-02 12:00:00' - to_minutes(pos * 30), '%Y-%m-%d %H:%M:%S') AS published_at FROM p""",
)
def _(spark, d):
    rows = feeds.listing_posts(_listing(spark, d)).withColumn("published_at", stamp("published_at"))
    return rows.select("board", "pos", "title", "url", "author", "score", "num_comments", "velocity_score", "is_spike", "summary", "flair", "published_at")


@query(
    "S6_listing_comments",
    LINES_SQL
    + """, c AS (SELECT *, pos % 5 AS score FROM r WHERE pos % 6 <> 4)
SELECT CAST(doc_id AS VARCHAR) AS post_id, 't1_' || pos AS comment_ext_id, 'u/unknown' AS author, line AS content, score, pos % 2 AS depth FROM c
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) <= 15""",
)
def _(spark, d):
    child = lambda x, i: F.struct(
        F.struct(
            i.cast("string").alias("id"), F.when(i % 6 == 4, "[deleted]").otherwise(x).alias("body"), (i % 5).alias("score"), (i % 2).alias("depth"), F.lit(1767355200.0).alias("created_utc")
        ).alias("data")
    )
    listing = lambda children: F.struct(F.struct(children.alias("children")).alias("data"))
    body = F.to_json(F.array(listing(F.slice(F.transform("lines", child), 1, 0)), listing(F.transform("lines", child))))
    docs = _lines(spark, d).select(F.col("doc_id").cast("string").alias("post_id"), body.alias("body"), ts_literal(NOW).alias("as_of"))
    return feeds.listing_comments(docs).select("post_id", "comment_ext_id", "author", "content", "score", "depth")


@query(
    "S7_embedded_posts",
    LINES_SQL
    + """, k AS (SELECT doc_id, lang, list_filter(lines, lambda x: length(x) BETWEEN 10 AND 500)[1:10] AS caps FROM l),
c AS (SELECT doc_id, lang, unnest(caps) AS line, generate_subscripts(caps, 1) - 1 AS pos FROM k)
SELECT doc_id AS page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN length(line) > 80 THEN substring(line, 1, 80) || '...' ELSE line END AS title,
  'https://www.threads.net/@' || lang || '/post/' || CASE WHEN pos < 3 THEN 'code_' || pos ELSE 'thread_' || (pos + 1) END AS url,
  CASE WHEN pos < 2 THEN pos * 100 ELSE 150 + pos * 45 END AS score, CAST(floor(CASE WHEN pos < 2 THEN pos * 100 ELSE 150 + pos * 45 END * 15 / 100) + 10 AS BIGINT) AS num_comments,
  line AS summary, strftime(TIMESTAMP '2026-01-02 12:00:00' - to_hours(pos * 2 + 1), '%Y-%m-%d %H:%M:%S') AS published_at FROM c""",
)
def _(spark, d):
    caps = _joined(F.col("lines"), lambda x: F.concat(F.lit('{"text": "'), x, F.lit('"},')))
    codes = '"code": "code_0", "code": "code_1", "code": "code_2", "like_count": 0, "like_count": 100'
    html = F.concat(F.lit("<html><script>var a = 1;</script><script type='x'>["), caps, F.lit(codes + "]</script></html>"))
    pages = _lines(spark, d).select(F.col("doc_id").alias("page_id"), F.col("lang").alias("username"), html.alias("html"))
    return feeds.embedded_posts(pages, NOW).withColumn("published_at", stamp("published_at"))
