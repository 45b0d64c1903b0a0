"""Queries on articles, links, comments and captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions.core import from_epoch, json_text, ts_literal
from tidewire.functions.urls import TRACKING_PARAMS
from tidewire.operators import articles as ar
from tidewire.operators import events as ev
from tidewire.operators import sinks
from tidewire.plans.registry import listed, query, stamp
from tidewire.plans.views import with_views
from tidewire.session import scratch_dir
from tidewire.sources import articles as article_scans
from tidewire.sources import standins

HISTORY = "2026-01-02 00:00:00"
_P = "strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at"


def canon_sql(u: str) -> str:
    """Canonical form of a URL expression as SQL."""
    dec = lambda e: f"url_decode(replace({e}, '+', ' '))"
    enc = lambda e: f"replace(url_encode({e}), '%20', '+')"
    base, frag = f"split_part(split_part({u}, '#', 1), '?', 1)", f"split_part({u}, '#', 1)"
    key, val = "split_part(p, '=', 1)", "substr(p, length(split_part(p, '=', 1)) + 2)"
    drop = ", ".join(f"'{x}'" for x in TRACKING_PARAMS)
    kept = (
        f"array_to_string(list_transform(list_filter(string_split(substr({frag}, length({base}) + 2), '&'), lambda p: "
        f"regexp_matches(p, '^[^=]*=.') AND NOT starts_with({dec(key)}, 'utm_') AND {dec(key)} NOT IN ({drop})), "
        f"lambda p: {enc(dec(key))} || '=' || {enc(dec(val))}), '&')"
    )
    return f"regexp_replace({base} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END, '/+$', '')"


@query("F1_list_articles", with_views("articles") + "SELECT id, source_id, url, category FROM articles WHERE source_id = 7 AND category = 'fr' ORDER BY id DESC LIMIT 20")
def _(spark, d):
    return ar.paginate(ar.filter_articles(standins.articles(spark, d), 7, "fr")).select("id", "source_id", "url", "category")


@query("F1_list_total", with_views("articles") + "SELECT count(*) AS total FROM articles WHERE category = 'fr'")
def _(spark, d):
    return ar.total(ar.filter_articles(standins.articles(spark, d), 0, "fr"))


@query("T1_paginate", with_views("articles") + "SELECT id, title FROM articles ORDER BY id DESC LIMIT 50 OFFSET 100")
def _(spark, d):
    return ar.paginate(standins.articles(spark, d), 3, 50).select("id", "title")


@query("T1_page_before", with_views("articles") + "SELECT id, title FROM articles WHERE id < 150 ORDER BY id DESC LIMIT 50")
def _(spark, d):
    return ar.page_before(standins.articles(spark, d), 150, 50).select("id", "title")


@query("F2_search_page", with_views("articles") + "SELECT id, title FROM articles WHERE title ILIKE '%Tion_%' OR content ILIKE '%Tion_%' ORDER BY id DESC LIMIT 20")
def _(spark, d):
    return ar.paginate(ar.search_articles(standins.articles(spark, d), "Tion_")).select("id", "title")


@query("F2_search_total", with_views("articles") + "SELECT count(*) AS total FROM articles WHERE contains(lower(title), 'ing the') OR contains(lower(content), 'ing the')")
def _(spark, d):
    return ar.total(ar.search_articles(standins.articles(spark, d), "ING the", literal=True))


@query("F3_get_by_id", with_views("articles") + f"SELECT id, url, title, content, {_P} FROM articles WHERE id = 42")
def _(spark, d):
    return ar.get_by_id(standins.articles(spark, d), 42).select("id", "url", "title", "content", stamp("published_at").alias("published_at"))


@query("F13_keep_content", with_views("articles") + "SELECT id FROM articles WHERE length(content) >= 400")
def _(spark, d):
    return ar.keep_content(standins.articles(spark, d), "content", 400).select("id")


@query("F13_backfill_gate", with_views("articles") + f"SELECT id FROM articles WHERE length(content) >= {ar.MIN_BACKFILLED}")
def _(spark, d):
    """What a backfill keeps of the pages that it has extracted."""
    return ar.keep_content(standins.articles(spark, d), "content", ar.MIN_BACKFILLED).select("id")


TEXT_SQL = """((summary IS NULL OR summary = '' OR NOT coalesce(CAST(metadata->>'$.nlp_processed' AS BOOLEAN), false)))"""
IMAGE_SQL = """(coalesce(json_array_length(metadata->'$.images'), 0) > 0 AND NOT coalesce(CAST(metadata->>'$.vision_processed' AS BOOLEAN), false))"""


@query(
    "F5_pending_text",
    "WITH RECURSIVE "
    + with_views("articles")[5:]
    + f""", newest AS (SELECT id, source_id, url, title, published_at, row_number() OVER (ORDER BY published_at DESC, id DESC) AS r FROM articles
  WHERE {TEXT_SQL} ORDER BY r LIMIT 200),
fold AS (SELECT r, [url] AS urls, [title] AS titles, [id] AS ids FROM newest WHERE r = 1
  UNION ALL SELECT n.r, CASE WHEN ok THEN list_append(urls, n.url) ELSE urls END, CASE WHEN ok THEN list_append(titles, n.title) ELSE titles END,
    CASE WHEN ok THEN list_append(ids, n.id) ELSE ids END
  FROM (SELECT f.*, m.r AS nr, len(f.ids) < 8 AND NOT list_contains(f.urls, m.url) AND NOT list_contains(f.titles, m.title) AS ok FROM fold f JOIN newest m ON m.r = f.r + 1) f
  JOIN newest n ON n.r = f.nr)
SELECT id, source_id, url, title, {_P} FROM newest WHERE list_contains((SELECT arg_max(ids, r) FROM fold), id)""",
)
def _(spark, d):
    return ar.pending_text(standins.articles(spark, d)).withColumn("published_at", stamp("published_at"))


@query("F6_pending_images", with_views("articles") + f"SELECT id, url, title FROM articles WHERE {IMAGE_SQL} ORDER BY published_at DESC, id DESC LIMIT 4")
def _(spark, d):
    return ar.pending_images(standins.articles(spark, d)).select("id", "url", "title")


@query(
    "A8_pending_counts",
    with_views("articles") + f"SELECT count(*) AS total, count(*) FILTER ({TEXT_SQL}) AS text_pending, count(*) FILTER ({IMAGE_SQL}) AS vision_pending FROM articles",
)
def _(spark, d):
    return ar.pending_counts(standins.articles(spark, d))


@query(
    "A7_queue_stats",
    with_views("article_images")
    + "SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in ar.IMAGE_STATES) + ", count(*) AS total FROM article_images",
)
def _(spark, d):
    return ar.queue_stats(standins.article_images(spark, d))


COLLECTORS_SQL = with_views("crawl_sources") + """, c AS (SELECT id, name, coalesce(ai_parsing_hints->>'$.collector_type', 'rule_seed') AS collector_type,
  coalesce(ai_parsing_hints->>'$.target_url_or_query', base_url) AS target, base_url, category, crawl_interval_minutes, is_active FROM crawl_sources)
"""


@query("F9_collectors_all", COLLECTORS_SQL + "SELECT * FROM c")
def _(spark, d):
    return ar.collectors(standins.crawl_sources(spark, d), "all")


@query("F9_collectors_of_type", COLLECTORS_SQL + "SELECT * FROM c WHERE collector_type = 'us_market_signal'")
def _(spark, d):
    return ar.collectors(standins.crawl_sources(spark, d), "us_market_signal")


CUSTOM_SQL = "(category = 'market_feed_site' OR coalesce(ai_parsing_hints->>'$.collector_type' = 'target_site', false))"


@query("F10_catalog_custom", with_views("crawl_sources") + f"SELECT id, name, category FROM crawl_sources WHERE {CUSTOM_SQL}")
def _(spark, d):
    return ar.custom_entries(standins.crawl_sources(spark, d), "market_feed_site", "target_site").select("id", "name", "category")


@query(
    "U1_catalog",
    with_views("crawl_sources")
    + f"""SELECT 'builtin-' || n_nationkey AS id, n_name AS name, 'https://feeds.example.com/' || n_nationkey AS url, 'us_market' AS category, true AS is_active,
  'preset' AS description, true AS is_builtin, 0 AS rank FROM nation
UNION ALL SELECT CAST(id AS VARCHAR), name, coalesce(ai_parsing_hints->>'$.target_url', base_url), coalesce(ai_parsing_hints->>'$.feed_category', 'us_market'), is_active,
  coalesce(ai_parsing_hints->>'$.description', ''), false, 1 FROM crawl_sources WHERE {CUSTOM_SQL}""",
)
def _(spark, d):
    key = F.col("n_nationkey").cast("string")
    builtin = standins.table(spark, d, "nation").select(
        F.concat(F.lit("builtin-"), key).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("https://feeds.example.com/"), key).alias("url"),
        F.lit("us_market").alias("category"), F.lit(True).alias("is_active"), F.lit("preset").alias("description"),
    )
    return ar.catalog(builtin, standins.crawl_sources(spark, d), "market_feed_site", "target_site")


@query(
    "S2_read_articles",
    with_views("articles")
    + f"SELECT id, url, {_P} FROM articles WHERE published_at >= TIMESTAMP '2026-01-01 00:00:00' AND published_at < TIMESTAMP '2026-01-02 00:00:00'",
)
def _(spark, d):
    import datetime as dt

    path = scratch_dir(spark, "articles")
    article_scans.write_articles(standins.articles(spark, d), path)
    rows = article_scans.read_articles(spark, path, dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2))
    return rows.select("id", "url", stamp("published_at").alias("published_at"))


# Candidate links: every stored URL again, once with tracking and once with a fragment. History is what was published before HISTORY.
CANDIDATES_SQL = with_views("articles") + f""", candidates AS (
  SELECT id * 2 AS pos, source_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'fbclid=z&page=' || (id % 3) AS url, strftime(published_at, '%Y-%m-%d') AS scan_id
  FROM articles UNION ALL SELECT id * 2 + 1, source_id, 'https://news.example.com/' || category || '/' || (id // 2) || '?q=a%20b&e=#x', strftime(published_at, '%Y-%m-%d') FROM articles),
canon AS (SELECT *, {canon_sql('url')} AS canonical FROM candidates),
stored AS (SELECT url, {canon_sql('url')} AS canonical FROM articles WHERE published_at < TIMESTAMP '{HISTORY}'),
fresh AS (SELECT * FROM canon WHERE canonical NOT IN (SELECT canonical FROM stored) AND canonical NOT IN (SELECT url FROM stored) AND url NOT IN (SELECT url FROM stored)),
firsts AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY pos) = 1)
"""


def _candidates(spark, d):
    a = standins.articles(spark, d)
    sep = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    scan = F.date_format("published_at", "yyyy-MM-dd").alias("scan_id")
    first = a.select(
        (F.col("id") * 2).alias("pos"), "source_id", F.concat("url", sep, F.lit("fbclid=z&page="), (F.col("id") % 3).cast("string")).alias("url"), scan
    )
    second = a.select(
        (F.col("id") * 2 + 1).alias("pos"),
        "source_id",
        F.concat(F.lit("https://news.example.com/"), "category", F.lit("/"), F.floor(F.col("id") / 2).cast("string"), F.lit("?q=a%20b&e=#x")).alias("url"),
        scan,
    )
    return first.unionByName(second)


def _history(spark, d):
    return standins.articles(spark, d).where(F.col("published_at") < ts_literal(HISTORY))


@query("J3_new_urls", CANDIDATES_SQL + "SELECT pos, source_id, url FROM firsts")
def _(spark, d):
    return ar.new_urls(_candidates(spark, d), _history(spark, d), ["pos", "source_id", "url"])


@query("U2_candidates_minus_stored", CANDIDATES_SQL + "SELECT DISTINCT canonical FROM fresh")
def _(spark, d):
    from tidewire.functions.urls import canonical_url

    return ar.new_urls(_candidates(spark, d), _history(spark, d), ["url"]).select(canonical_url("url").alias("canonical"))


@query("W2_first_per_canonical_url", CANDIDATES_SQL + "SELECT min(pos) AS pos, canonical FROM canon GROUP BY canonical")
def _(spark, d):
    from tidewire.functions.urls import canonical_url
    from tidewire.operators.keys import first_per_key

    keyed = _candidates(spark, d).withColumn("canonical", canonical_url("url"))
    return first_per_key(keyed, ["canonical"], "pos").select("pos", "canonical")


@query("W8_cap_per_source", CANDIDATES_SQL + "SELECT pos, source_id FROM firsts QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY pos) <= 10")
def _(spark, d):
    fresh = ar.new_urls(_candidates(spark, d), _history(spark, d), ["pos", "source_id"])
    return ar.cap_per_source(fresh)


@query(
    "A20_scan_summary",
    CANDIDATES_SQL
    + """SELECT c.source_id, c.scan_id, count(*) AS candidate_count, count(f.pos) AS new_count FROM candidates c LEFT JOIN firsts f ON f.pos = c.pos GROUP BY 1, 2""",
)
def _(spark, d):
    return ev.scan_summary(ar.mark_new(_candidates(spark, d), _history(spark, d)))


@query(
    "K1_append_new",
    with_views("articles")
    + f""", batch AS (SELECT id AS pos, id, url, published_at, 'first' AS tag FROM articles UNION ALL SELECT id + 100000000, id, url, published_at, 'second' FROM articles),
old AS (SELECT id, url, published_at, 'stored' AS tag FROM articles WHERE published_at < TIMESTAMP '{HISTORY}')
SELECT id, url, {_P}, tag FROM (SELECT * FROM old UNION ALL SELECT id, url, published_at, tag FROM
  (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY url, published_at ORDER BY pos) = 1) b
  WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.url = b.url AND o.published_at = b.published_at)) q""",
)
def _(spark, d):
    a = standins.articles(spark, d).select("id", "url", "published_at")
    old = _history(spark, d).select("id", "url", "published_at", F.lit("stored").alias("tag"))
    batch = a.select("*", F.lit("first").alias("tag"), F.col("id").alias("pos")).unionByName(
        a.select("*", F.lit("second").alias("tag"), (F.col("id") + 100000000).alias("pos"))
    )
    return sinks.append_new(old, batch).withColumn("published_at", stamp("published_at"))


@query(
    "K2_upsert_comments",
    with_views("comments")
    + """, batch AS (SELECT article_id, CASE WHEN author = 'user' THEN comment_ext_id ELSE comment_ext_id || '_new' END AS comment_ext_id, author || '!' AS author, content || '!' AS content,
  score + 1000 AS score FROM comments)
SELECT coalesce(c.article_id, b.article_id) AS article_id, coalesce(c.comment_ext_id, b.comment_ext_id) AS comment_ext_id, coalesce(c.author, b.author) AS author,
  coalesce(b.content, c.content) AS content, coalesce(b.score, c.score) AS score FROM comments c FULL JOIN batch b ON b.article_id = c.article_id AND b.comment_ext_id = c.comment_ext_id""",
)
def _(spark, d):
    target = standins.comments(spark, d).select("article_id", "comment_ext_id", "author", "content", "score")
    ext = F.when(F.col("author") == "user", F.col("comment_ext_id")).otherwise(F.concat("comment_ext_id", F.lit("_new")))
    batch = target.select(
        "article_id", ext.alias("comment_ext_id"), F.concat("author", F.lit("!")).alias("author"), F.concat("content", F.lit("!")).alias("content"),
        (F.col("score") + 1000).alias("score"), F.lit(0).alias("pos"),
    )
    return sinks.upsert(target, batch, sinks.COMMENT_KEYS, ["content", "score"])


@query(
    "K2_upsert_sources",
    with_views("crawl_sources")
    + """, batch AS (SELECT id + 7 AS id, name || '!' AS name, base_url || '/new' AS base_url, 'stock' AS category, '{}' AS ai_parsing_hints FROM crawl_sources)
SELECT coalesce(s.id, b.id) AS id, coalesce(b.name, s.name) AS name, coalesce(b.base_url, s.base_url) AS base_url, coalesce(b.category, s.category) AS category,
  CASE WHEN b.id IS NULL THEN s.ai_parsing_hints ELSE b.ai_parsing_hints END AS ai_parsing_hints, CASE WHEN s.id IS NULL THEN 15 ELSE s.crawl_interval_minutes END AS crawl_interval_minutes
FROM crawl_sources s FULL JOIN batch b ON b.id = s.id""",
)
def _(spark, d):
    target = standins.crawl_sources(spark, d).drop("is_active")
    batch = target.select(
        (F.col("id") + 7).alias("id"), F.concat("name", F.lit("!")).alias("name"), F.concat("base_url", F.lit("/new")).alias("base_url"), F.lit("stock").alias("category"),
        F.lit(15).alias("crawl_interval_minutes"), F.lit("{}").alias("ai_parsing_hints"), F.lit(0).alias("pos"),
    )
    return sinks.upsert(target, batch, ["id"], ["name", "base_url", "category", "ai_parsing_hints"])


META_SQL = """coalesce(metadata->>'$.nlp_processed', '') AS nlp_processed, coalesce(metadata->>'$.vision_processed', '') AS vision_processed,
  coalesce(metadata->>'$.nlp_error', '') AS nlp_error, coalesce(json_array_length(metadata->'$.images'), 0) AS n_images"""


def _meta(rows, *keep):
    text = lambda k: F.coalesce(json_text("metadata", k), F.lit("")).alias(k)
    return rows.select(*keep, text("nlp_processed"), text("vision_processed"), text("nlp_error"), F.coalesce(F.json_array_length(json_text("metadata", "images")), F.lit(0)).cast("long").alias("n_images"))


@query(
    "K3_merge_json",
    with_views("articles")
    + f""", m AS (SELECT id, json_merge_patch(coalesce(metadata, '{{}}'), json_object('nlp_processed', true, 'nlp_error', substring(content, 1, 200), 'nlp_failed_at', '2026-01-02T12:00:00')) AS metadata FROM articles)
SELECT id, {META_SQL} FROM m""",
)
def _(spark, d):
    a = standins.articles(spark, d)
    patched = a.withColumn("metadata", sinks.merge_json(F.col("metadata"), sinks.failure_patch(F.col("content"), ts_literal(standins.ARTICLES_AS_OF))))
    return _meta(patched, "id")


@query(
    "K9_apply_enrichment",
    with_views("articles")
    + f""", r AS (SELECT doc_id, 'S' || doc_id AS summary, CAST(quality - toxic AS DOUBLE) AS sentiment_score FROM labels),
e AS (SELECT a.id, CASE WHEN r.doc_id IS NULL THEN a.summary ELSE r.summary END AS summary, r.sentiment_score,
  CASE WHEN r.doc_id IS NULL THEN a.metadata ELSE json_merge_patch(coalesce(a.metadata, '{{}}'), '{{"nlp_processed":true,"vision_processed":false}}') END AS metadata
  FROM articles a LEFT JOIN r ON r.doc_id = a.id)
SELECT id, summary, sentiment_score, {META_SQL} FROM e""",
)
def _(spark, d):
    a = standins.articles(spark, d)
    labels = standins.table(spark, d, "labels")
    results = a.join(labels, a["id"] == labels["doc_id"]).select(
        "url", "published_at", F.concat(F.lit("S"), F.col("id").cast("string")).alias("summary"), (F.col("quality") - F.col("toxic")).cast("double").alias("sentiment_score"),
        F.lit('{"nlp_processed":true,"vision_processed":false}').alias("patch"),
    )
    return _meta(sinks.apply_enrichment(a, results), "id", "summary", "sentiment_score")


@query(
    "J5_propagate_by_title",
    with_views("articles")
    + f""", donor AS (SELECT title, arg_max(summary, published_at) AS d_summary, arg_max(length(summary), published_at) / 100.0::DOUBLE AS d_score FROM articles
  WHERE summary <> '' AND title <> '' GROUP BY 1),
e AS (SELECT a.id, CASE WHEN coalesce(a.summary, '') = '' AND d.title IS NOT NULL THEN d_summary ELSE a.summary END AS summary,
  CASE WHEN coalesce(a.summary, '') = '' AND d.title IS NOT NULL THEN d_score END AS sentiment_score,
  CASE WHEN coalesce(a.summary, '') = '' AND d.title IS NOT NULL THEN json_merge_patch(coalesce(a.metadata, '{{}}'), '{{"nlp_processed":true}}') ELSE a.metadata END AS metadata
  FROM articles a LEFT JOIN donor d ON d.title = a.title)
SELECT id, summary, sentiment_score, {META_SQL} FROM e""",
)
def _(spark, d):
    a = standins.articles(spark, d)
    enriched = a.where(F.col("summary") != "").select(
        "title", "summary", (F.length("summary") / 100.0).alias("sentiment_score"), F.lit('{"nlp_processed":true}').alias("patch"), "published_at"
    )
    return _meta(ar.propagate_by_title(a, enriched), "id", "summary", "sentiment_score")


@query(
    "J6_comment_parent",
    with_views("articles")
    + """, versions AS (SELECT id, url, published_at FROM articles UNION ALL SELECT id + 1000000000, url, published_at - INTERVAL 1 DAY FROM articles)
SELECT a.id AS comment_id, (SELECT arg_max(v.id, v.published_at) FROM versions v WHERE v.url = a.url) AS article_id FROM articles a""",
)
def _(spark, d):
    a = standins.articles(spark, d)
    older = a.select((F.col("id") + 1000000000).alias("id"), "url", (F.col("published_at") - F.make_dt_interval(days=F.lit(1))).alias("published_at"))
    comments = a.select(F.col("id").alias("comment_id"), "url")
    return ar.comment_parent(comments, a.select("id", "url", "published_at").unionByName(older)).select("comment_id", "article_id")


COMMENTS_SQL = with_views("comments", "articles") + """, stored AS (SELECT article_id, comment_ext_id, author, content, score, depth FROM comments
  QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY score DESC, published_at DESC, comment_ext_id) <= 3),
lines AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM articles
  WHERE id NOT IN (SELECT article_id FROM comments))
"""


def _with_listed_comments(spark, d):
    """Articles whose JSON lists all lines of their text as comments; the first carries its own id."""
    lines = F.split("content", "\n")
    shaped = F.transform(lines, lambda l, i: F.struct(F.when(i == 0, F.lit("own")).alias("comment_ext_id"), l.alias("content"), (i + 5).alias("score")))
    return standins.articles(spark, d).withColumn("metadata", F.to_json(F.struct(shaped.alias("top_comments"))))


@query(
    "J7_comments_of",
    COMMENTS_SQL
    + """SELECT * FROM stored UNION ALL SELECT id, CASE WHEN pos = 1 THEN 'own' ELSE 'c_' || (pos - 1) END, '익명', line, CAST(pos + 4 AS INTEGER), 0 FROM lines""",
)
def _(spark, d):
    return ar.comments_of(standins.comments(spark, d), _with_listed_comments(spark, d), n=3)


@query("J7_comments_of_one", COMMENTS_SQL + "SELECT * FROM stored WHERE article_id = 3")
def _(spark, d):
    return ar.comments_of(standins.comments(spark, d), _with_listed_comments(spark, d), 3, 3)


@query("T4_top_comments", COMMENTS_SQL + "SELECT article_id, comment_ext_id, score FROM stored")
def _(spark, d):
    return ar.top_comments(standins.comments(spark, d), 3).select("article_id", "comment_ext_id", "score")


@query(
    "A21_comment_summary",
    with_views("comments")
    + """, best AS (SELECT * FROM comments QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY score DESC, published_at DESC, comment_ext_id) <= 5)
SELECT article_id, (SELECT count(*) FROM comments c WHERE c.article_id = b.article_id) AS comment_count,
  string_agg(comment_ext_id, '|' ORDER BY score DESC, published_at DESC, comment_ext_id) AS top_ids, '2026-01-02T12:00:00' AS crawled_at,
  first(content ORDER BY score DESC, published_at DESC, comment_ext_id) AS best_content FROM best b GROUP BY 1""",
)
def _(spark, d):
    out = ar.comment_summary(standins.comments(spark, d), ts_literal(standins.ARTICLES_AS_OF))
    return out.select(
        "article_id", "comment_count", listed("top_ids").alias("top_ids"), F.get_json_object("patch", "$.last_comment_crawled_at").alias("crawled_at"),
        F.get_json_object("patch", "$.top_comments[0].content").alias("best_content"),
    )


_CAP = "chr(10) || chr(10) || '[🖼️ 첨부 이미지 #' || {o} || ' 내용: ' || {t} || ']' || chr(10) || chr(10)"


@query(
    "K3_merge_comment_patch",
    with_views("comments", "articles")
    + """SELECT a.id, CAST(count(*) AS VARCHAR) AS comment_count, '2026-01-02T12:00:00' AS crawled_at FROM articles a JOIN comments c ON c.article_id = a.id GROUP BY a.id""",
)
def _(spark, d):
    patches = ar.comment_summary(standins.comments(spark, d), ts_literal(standins.ARTICLES_AS_OF)).select(F.col("article_id").alias("id"), "patch")
    merged = standins.articles(spark, d).select("id", "metadata").join(patches, "id").select("id", sinks.merge_json(F.col("metadata"), F.col("patch")).alias("m"))
    return merged.select("id", F.get_json_object("m", "$.comment_count").alias("comment_count"), F.get_json_object("m", "$.last_comment_crawled_at").alias("crawled_at"))


@query(
    "M17_inject_captions",
    with_views("articles", "article_images")
    + f""", a AS (SELECT id, content || CASE WHEN id % 2 = 0 THEN ' {{{{IMG:1:https://img.example.com/' || (id * 4) || '.png}}}} end' ELSE '' END AS content FROM articles),
done AS (SELECT *, {_CAP.format(o='order_index', t='description')} AS text FROM article_images WHERE status = 'COMPLETED'),
p AS (SELECT article_id, max(text) FILTER (order_index = 1) AS first_text, coalesce(string_agg(text, '' ORDER BY order_index) FILTER (order_index > 1), '') AS rest FROM done GROUP BY 1)
SELECT a.id, CASE WHEN first_text IS NULL THEN content WHEN id % 2 = 0 THEN replace(content, '{{{{IMG:1:https://img.example.com/' || (id * 4) || '.png}}}}', first_text) ELSE content || first_text END
  || coalesce(rest, '') AS content FROM a LEFT JOIN p ON p.article_id = a.id""",
)
def _(spark, d):
    token = F.concat(F.lit(" {{IMG:1:https://img.example.com/"), (F.col("id") * 4).cast("string"), F.lit(".png}} end"))
    a = standins.articles(spark, d).select("id", F.concat("content", F.when(F.col("id") % 2 == 0, token).otherwise("")).alias("content"))
    return ar.inject_captions(a, standins.article_images(spark, d)).select("id", "content")


@query(
    "K4_ingest_events",
    with_views("articles")
    + """, i AS (SELECT source_id, url, title, content, string_split(content, ' ')[1:3] AS images FROM articles)
SELECT source_id, url, 'article_ingest' AS event_type, substring(title, 1, 500) AS title, NULL AS image_url FROM i
UNION ALL SELECT source_id, url, 'image_ingest', '이미지: ' || substring(title, 1, 40), unnest(images) FROM i""",
)
def _(spark, d):
    batch = standins.articles(spark, d).select(
        "source_id", "title", "url", F.split("content", " ").alias("images"), F.to_json(F.struct("author")).alias("details"), F.col("crawled_at").alias("created_at")
    )
    return sinks.ingest_events(batch).select("source_id", "url", "event_type", "title", "image_url")


@query(
    "K5_append_term_freq",
    with_views("articles") + "SELECT category AS term, source_id, count(*) AS frequency, strftime(published_at, '%Y-%m-%d') AS dt FROM articles GROUP BY ALL",
)
def _(spark, d):
    path = scratch_dir(spark, "term-freq")
    rows = standins.articles(spark, d).groupBy(F.date_trunc("day", "published_at").alias("time"), "source_id", F.col("category").alias("term")).agg(F.count("*").alias("frequency"))
    sinks.append_term_freq(rows, path)
    return spark.read.parquet(path).select("term", "source_id", "frequency", F.col("dt").cast("string").alias("dt"))


@query(
    "K4_events_by_day",
    with_views("articles")
    + """, i AS (SELECT source_id, url, crawled_at, string_split(content, ' ')[1:3] AS images FROM articles),
e AS (SELECT source_id, url, 'article_ingest' AS event_type, crawled_at FROM i UNION ALL SELECT source_id, url, 'image_ingest', crawled_at FROM (SELECT source_id, url, crawled_at, unnest(images) FROM i) q)
SELECT strftime(crawled_at, '%Y-%m-%d') AS dt, event_type, count(*) AS events, count(DISTINCT url) AS urls FROM e GROUP BY 1, 2""",
)
def _(spark, d):
    """Events of ingested articles, appended by day and read back."""
    path = scratch_dir(spark, "events-by-day")
    batch = standins.articles(spark, d).select(
        "source_id", "title", "url", F.split("content", " ").alias("images"), F.to_json(F.struct("author")).alias("details"), F.col("crawled_at").alias("created_at")
    )
    sinks.append_events(batch, path)
    return spark.read.parquet(path).groupBy(F.col("dt").cast("string").alias("dt"), "event_type").agg(F.count("*").alias("events"), F.countDistinct("url").alias("urls"))


@query("K1_article_rows", with_views("articles") + "SELECT id, substring(content, 1, 500) AS title, substring(author || content, 1, 100) AS author FROM articles")
def _(spark, d):
    """Long titles and authors cut to the stored widths."""
    long = standins.articles(spark, d).select("id", F.col("content").alias("title"), F.concat("author", "content").alias("author"))
    return sinks.article_row(long)
