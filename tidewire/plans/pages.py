"""Queries on raw pages: the given page table, and list pages built from the lines of each document."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import signals
from tidewire.functions.urls import url_domain
from tidewire.operators import pages as pg
from tidewire.operators.articles import MIN_ANCHOR, keep_content
from tidewire.operators.keys import top_per
from tidewire.plans.feeds import LINES_SQL, _joined, _lines
from tidewire.plans.registry import listed, query, stamp
from tidewire.sources import pages as scans
from tidewire.sources import standins


def _dealt(rows, key):
    """The rows of a table, dealt out by their key where its files are fewer than the cores. That comes before pages are built of them, so that no page is shuffled; as the table grows, so do the parts."""
    return rows if len(rows.inputFiles()) >= rows.sparkSession.sparkContext.defaultParallelism else rows.repartition(key)


def _scan(spark, d, **parts):
    return scans.scan_pages(_dealt(standins.table(spark, d, "pages").select("page_id", "url", "html"), "page_id"), **parts)


def _rich_pages(spark, d):
    """One list page per document: head metadata, a menu, a table, a list and a content block."""
    num = lambda i: i.cast("string")
    row = lambda x, i: F.concat(
        F.lit('<tr><td class="no">'), num(i), F.lit('</td><td class="title"><a class="t" href="/view/'), num(i), F.when(i % 4 == 3, "/login").otherwise(""), F.lit('">'), x, F.lit("</a></td></tr>")
    )
    item = lambda x, i: F.concat(F.lit('<li class="row"><a href="'), F.when(i % 3 == 0, "#top").otherwise(F.concat(F.lit("/news/2024/01/"), num(i))), F.lit('">'), x, F.lit("</a></li>"))
    key = F.col("doc_id").cast("string")
    html = F.concat(
        F.lit("<html><head><title> Page "), key, F.lit(' [3]</title><meta property="og:title" content="'),
        F.when(F.col("lang") == "en", F.concat(F.lit("OG "), key)).otherwise(""),
        F.lit('"><meta name="author" content="AbcAbc"><meta property="article:published_time" content="2024-02-03T04:05:06Z"><meta name="description" content="d'),
        key, F.lit('"><link rel="canonical" href="https://c.example.com/'), key,
        F.lit('"></head><body><nav><ul class="menu"><li><a href="/join">Join us now</a></li><li><a href="/about">About us all</a></li><li><a href="/x">Something else</a></li></ul></nav><table class="board">'),
        _joined(F.col("lines"), row), F.lit('</table><ul class="news">'), _joined(F.col("lines"), item),
        F.lit('</ul><div class="post_content"><p>'), F.array_join("lines", " "), F.lit('</p></div><div class="comment_area"><p>ignored text that is long enough</p></div></body></html>'),
    )
    docs = _dealt(standins.table(spark, d, "documents").select("doc_id", "text", "source", "lang"), "doc_id")
    return _lines(spark, d, docs).select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://list.example.com/"), key).alias("url"), html.alias("html"), "source", "lang")


def _rich_scan(spark, d, **parts):
    return scans.scan_pages(_rich_pages(spark, d), **parts)


LINKS = {"blocks": False}
ELEMENTS = {"anchors": False, "blocks": False, "elements": True}
BLOCKS = {"anchors": False}
HEAD = {"anchors": False, "blocks": False}


ANCHORS_SQL = """WITH a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS home, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">'), 1) - 1 AS pos FROM pages)
"""


@query(
    "S10_page_anchors",
    ANCHORS_SQL + "SELECT page_id, CAST(min(pos) AS INTEGER) AS pos, home || href AS abs_url, trim(arg_min(text, pos)) AS text FROM a GROUP BY page_id, home || href",
)
def _(spark, d):
    return scans.page_anchors(_scan(spark, d, **LINKS)).select("page_id", "pos", "abs_url", "text")


@query(
    "F13_anchor_gate",
    ANCHORS_SQL + f"SELECT page_id, CAST(pos AS INTEGER) AS pos FROM (SELECT page_id, min(pos) AS pos, trim(arg_min(text, pos)) AS text FROM a GROUP BY page_id, home || href) q WHERE length(text) >= {MIN_ANCHOR}",
)
def _(spark, d):
    """Links whose text is long enough to be a headline."""
    return keep_content(scans.page_anchors(_scan(spark, d, **LINKS)), "text", MIN_ANCHOR).select("page_id", "pos")


@query(
    "S10_page_anchors_of_lists",
    LINES_SQL
    + """, t AS (SELECT doc_id, 3 + pos AS pos, '/view/' || pos || CASE WHEN pos % 4 = 3 THEN '/login' ELSE '' END AS href, line FROM r),
u AS (SELECT doc_id, 3 + (SELECT count(*) FROM r r2 WHERE r2.doc_id = r.doc_id) + pos AS pos, CASE WHEN pos % 3 = 0 THEN '/' || doc_id || '#top' ELSE '/news/2024/01/' || pos END AS href, line FROM r),
m AS (SELECT doc_id, 0 AS pos, '/join' AS href, 'Join us now' AS line FROM l UNION ALL SELECT doc_id, 1, '/about', 'About us all' FROM l UNION ALL SELECT doc_id, 2, '/x', 'Something else' FROM l),
al AS (SELECT * FROM t UNION ALL SELECT * FROM u UNION ALL SELECT * FROM m)
SELECT doc_id AS page_id, CAST(min(pos) AS INTEGER) AS pos, 'https://list.example.com' || href AS abs_url, regexp_replace(arg_min(line, pos), ' +', ' ', 'g') AS text FROM al GROUP BY doc_id, href""",
)
def _(spark, d):
    return scans.page_anchors(_rich_scan(spark, d, **LINKS)).select("page_id", "pos", "abs_url", "text")


@query(
    "S11_page_metadata",
    LINES_SQL
    + """SELECT doc_id AS page_id, CASE WHEN lang = 'en' THEN 'OG ' || doc_id ELSE 'Page ' || doc_id || ' [3]' END AS title, CASE WHEN lang = 'en' THEN 'OG' ELSE 'Page ' || doc_id END AS clean_title,
  'Abc' AS author, '2024-02-03 04:05:06' AS published_at, 'd' || doc_id AS description, 'https://c.example.com/' || doc_id AS canonical_url, 'article' AS og_type FROM l""",
)
def _(spark, d):
    rows = scans.page_metadata(_rich_scan(spark, d, **HEAD)).withColumn("published_at", stamp("published_at"))
    return rows.select("page_id", "title", "clean_title", "author", "published_at", "description", "canonical_url", "og_type")


@query(
    "S11_page_titles",
    "SELECT page_id, url, trim(replace(replace(regexp_extract(html, '<h1>([^<]*)', 1), '&amp;', '&'), '&lt;', '<')) AS title, url AS canonical_url FROM pages",
)
def _(spark, d):
    return scans.page_metadata(_scan(spark, d, **HEAD)).select("page_id", "url", "title", "canonical_url")


@query("S12_page_blocks")
def _(spark, d):
    return scans.page_blocks(_scan(spark, d, **BLOCKS)).select("page_id", "pos", "selector", "tag", "text_len", "link_len", "img_count")


@query(
    "M11_article_links",
    LINES_SQL
    + """, t AS (SELECT doc_id, pos AS o, '/view/' || pos || CASE WHEN pos % 4 = 3 THEN '/login' ELSE '' END AS href, regexp_replace(line, ' +', ' ', 'g') AS text, 20 AS hit, CASE WHEN pos % 4 = 3 THEN 30 ELSE 0 END AS miss FROM r
  UNION ALL SELECT doc_id, 1000000 + pos, '/news/2024/01/' || pos, regexp_replace(line, ' +', ' ', 'g'), 40, 0 FROM r WHERE pos % 3 <> 0),
s AS (SELECT *, least(100, 10 + hit - miss + CASE WHEN length(text) >= 15 THEN 15 ELSE 0 END) AS score FROM t WHERE length(text) >= 4)
SELECT doc_id AS page_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) - 1 AS INTEGER) AS rank, 'https://list.example.com' || href AS link, text, score
FROM s WHERE score >= 20 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) <= 30""",
)
def _(spark, d):
    return pg.article_links(_rich_scan(spark, d, **LINKS))


BLOCKS_SQL = LINES_SQL + """, j AS (SELECT doc_id, len(lines) AS n, array_to_string(lines, ' ') AS body FROM l),
b AS (SELECT doc_id, pos * 2 AS pos, 'td.no' AS selector, length(CAST(pos AS VARCHAR)) AS text_len, 0 AS link_len FROM r
  UNION ALL SELECT doc_id, pos * 2 + 1, 'td.title', length(line), length(line) FROM r
  UNION ALL SELECT doc_id, n * 2, 'div.post_content', length(body), 0 FROM j UNION ALL SELECT doc_id, n * 2 + 1, 'p', length(body), 0 FROM j)
"""


@query(
    "S12_blocks_of_lists",
    BLOCKS_SQL + "SELECT doc_id AS page_id, CAST(pos AS INTEGER) AS pos, selector, CAST(text_len AS INTEGER) AS text_len, CAST(link_len AS INTEGER) AS link_len FROM b",
)
def _(spark, d):
    return scans.page_blocks(_rich_scan(spark, d, **BLOCKS)).select("page_id", "pos", "selector", "text_len", "link_len")


@query(
    "W6_top_items_per_page",
    BLOCKS_SQL + """SELECT doc_id AS page_id, CAST(pos AS INTEGER) AS pos, selector, CAST(text_len AS INTEGER) AS text_len FROM b
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY text_len DESC, pos) <= 3""",
)
def _(spark, d):
    blocks = scans.page_blocks(_rich_scan(spark, d, **BLOCKS)).select("page_id", "pos", "selector", "text_len")
    return top_per(blocks, ["page_id"], [F.desc("text_len"), F.asc("pos")], 3)


@query(
    "A16_selector_vote_of_lists",
    BLOCKS_SQL
    + """, v AS (SELECT source AS site, selector, count(DISTINCT doc_id) AS pages FROM b JOIN documents d USING (doc_id) WHERE text_len > 20 GROUP BY 1, 2)
SELECT site, 'content' AS field, first(selector ORDER BY pages DESC, selector) AS selector, max(pages) AS pages FROM v GROUP BY 1""",
)
def _(spark, d):
    scan = _rich_scan(spark, d, keep=("source",), **BLOCKS)
    blocks = scan.select("page_id", F.col("source").alias("site"), F.explode("blocks").alias("b")).where(F.col("b.text_len") > 20)
    return pg.selector_vote(blocks.select("site", "page_id", F.lit("content").alias("field"), scans.block_selector(F.col("b")).alias("selector")))


@query("M12_content_density")
def _(spark, d):
    return pg.content_density(_scan(spark, d, **BLOCKS)).select("page_id", "rank", "selector", "score", "text_len", "img_count")


@query(
    "M12_content_of_lists",
    LINES_SQL
    + """, c AS (SELECT doc_id, length(array_to_string(lines, ' ')) AS n FROM l)
SELECT doc_id AS page_id, CAST(0 AS INTEGER) AS rank, 'div.post_content' AS selector, CAST(n + 1000 AS DOUBLE) AS score, CAST(n AS INTEGER) AS text_len FROM c WHERE n >= 20""",
)
def _(spark, d):
    return pg.content_density(_rich_scan(spark, d, **BLOCKS), 1).where(F.col("selector") == "div.post_content").select("page_id", "rank", "selector", "score", "text_len")


@query("A16_selector_vote")
def _(spark, d):
    blocks = pg.content_density(_scan(spark, d, **BLOCKS))
    site = F.regexp_extract(url_domain("url"), r"([a-z]+)$", 1)
    return pg.selector_vote(blocks.select(site.alias("site"), "page_id", F.lit("content").alias("field"), "selector"))


@query(
    "A17_anchor_groups",
    LINES_SQL
    + """, n AS (SELECT doc_id, len(lines) AS n, list_filter(list_transform(lines, lambda x: regexp_replace(x, ' +', ' ', 'g')), lambda x: true) AS lines FROM l),
g AS (SELECT doc_id, n, 'table.board a' AS selector, 'table' AS tag, 'board' AS class, true AS probable, 0 AS kind,
    list_filter(lines[1:20], lambda x: length(x) > 1) AS valid FROM n WHERE n >= 3
  UNION ALL SELECT doc_id, n, 'ul.news a', 'ul', 'news', true, 1, list_filter(lines[1:20], lambda x, i: length(x) > 1 AND (i - 1) % 3 <> 0) FROM n WHERE n BETWEEN 3 AND 100
  UNION ALL SELECT doc_id, 3, 'ul.menu a', 'ul', 'menu', false, 1, ['Join us now', 'About us all', 'Something else'] FROM n)
SELECT doc_id AS page_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY probable DESC, n DESC, kind) - 1 AS INTEGER) AS rank, selector, tag, class, CAST(n AS INTEGER) AS link_count, probable,
  array_to_string(list_transform(valid[1:5], lambda x: substring(x, 1, 40)), '|') AS samples FROM g WHERE len(valid) >= 2""",
)
def _(spark, d):
    return pg.anchor_groups(_rich_scan(spark, d, **LINKS)).withColumn("samples", listed("samples"))


@query(
    "A19_common_parent",
    LINES_SQL
    + """, e AS (SELECT doc_id, lines[1] AS a, lines[len(lines)] AS b FROM l WHERE len(lines) > 0),
h AS (SELECT r.doc_id, CAST(contains(r.line, a) OR contains(a, r.line) AS BIGINT) + CAST(contains(r.line, b) OR contains(b, r.line) AS BIGINT) AS n
  FROM (SELECT doc_id, pos, regexp_replace(line, ' +', ' ', 'g') AS line FROM r) r JOIN e ON e.doc_id = r.doc_id)
SELECT doc_id AS page_id, '.row a' AS selector, CAST(sum(n) AS BIGINT) AS matches FROM h GROUP BY 1 HAVING sum(n) > 0""",
)
def _(spark, d):
    lines = _lines(spark, d).where(F.size("lines") > 0)
    examples = lines.select(F.col("doc_id").alias("page_id"), F.array(F.element_at("lines", 1), F.element_at("lines", -1)).alias("examples"))
    return pg.common_parent(_rich_scan(spark, d, **LINKS), examples)


@query(
    "U5_link_cascade",
    LINES_SQL
    + """, ru AS (SELECT doc_id, 'rule' AS method, pos, '/view/' || pos || CASE WHEN pos % 4 = 3 THEN '/login' ELSE '' END AS href, line FROM r WHERE lang = 'fr'),
rw AS (SELECT doc_id, 'rows' AS method, pos, '/view/' || pos AS href, line FROM r WHERE lang <> 'fr' AND pos % 4 <> 3 AND length(line) >= 2),
al AS (SELECT * FROM ru UNION ALL SELECT * FROM rw)
SELECT doc_id AS page_id, method, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, 'https://list.example.com' || href AS link, trim(line) AS title, trim(line) AS anchor_text,
  NULL::VARCHAR AS snippet, NULL::VARCHAR AS press, NULL::VARCHAR AS time_text, NULL::VARCHAR AS thumbnail FROM al""",
)
def _(spark, d):
    return pg.link_cascade(_rich_scan(spark, d, keep=("lang",), **ELEMENTS), F.when(F.col("lang") == "fr", "t"))


_NOTICES = " OR ".join(f"contains(text, '{w}')" for w in pg.NOTICE_WORDS)
NOTICE_SQL = LINES_SQL + ", n AS (SELECT doc_id AS page_id, CAST(pos AS INTEGER) AS pos, CASE pos % 5 WHEN 1 THEN '[AD] ' WHEN 3 THEN '필독: ' ELSE '' END || line AS text FROM r)\n"


def _notices(spark, d):
    r = _lines(spark, d).select(F.col("doc_id").alias("page_id"), F.posexplode("lines").alias("pos", "line"))
    head = F.when(F.col("pos") % 5 == 1, "[AD] ").when(F.col("pos") % 5 == 3, "필독: ").otherwise("")
    return r.select("page_id", "pos", F.concat(head, "line").alias("text"))


@query("F14_notice_filter_kept", NOTICE_SQL + f"SELECT page_id, pos, text FROM n WHERE NOT ({_NOTICES})")
def _(spark, d):
    return pg.notice_filter(_notices(spark, d))[0]


@query("F14_notice_filter_excluded", NOTICE_SQL + f"SELECT page_id, pos, substring(text, 1, 60) AS sample FROM n WHERE {_NOTICES}")
def _(spark, d):
    return pg.notice_filter(_notices(spark, d))[1].select("page_id", "pos", "sample")


@query(
    "F15_negative_terms",
    LINES_SQL
    + """, f AS (SELECT doc_id, pos, line, contains(lower(line), 'the') OR contains(lower(line), 'que') AS bad FROM r), k AS (SELECT *, bool_and(bad) OVER (PARTITION BY doc_id) AS all_bad FROM f)
SELECT doc_id AS page_id, line AS text FROM k WHERE NOT bad OR all_bad""",
)
def _(spark, d):
    items = F.transform("lines", lambda x: F.struct(x.alias("text")))
    kept = pg.drop_negative(items, ["The ", "que", " "])
    return _lines(spark, d).select(F.col("doc_id").alias("page_id"), F.inline(kept))


@query(
    "M13_rule_confidence",
    """WITH c AS (SELECT source, count(*) AS links, max(length(text)) AS chars, max(lang) AS title FROM documents GROUP BY source, lang)
SELECT source, title, CAST(least(10, CASE WHEN links >= 5 THEN 4 WHEN links >= 1 THEN 2 ELSE 0 END + CASE WHEN chars > 100 THEN 4 WHEN chars > 20 THEN 2 ELSE 0 END + 2) AS DOUBLE) / 10.0::DOUBLE AS confidence FROM c""",
)
def _(spark, d):
    doc = standins.table(spark, d, "documents")
    per = doc.groupBy("source", "lang").agg(F.count("*").alias("links"), F.max_by("text", F.length("text")).alias("content"))
    return per.select("source", F.col("lang").alias("title"), signals.rule_confidence("links", "content", "lang").alias("confidence"))
