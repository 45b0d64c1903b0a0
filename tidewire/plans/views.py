"""The stand-in tables of ``tidewire.sources.standins`` as SQL, for the value checks."""

from __future__ import annotations

from tidewire.sources.standins import EVENT_TYPES

_EVENT_CASE = "CASE WHEN event_id % 11 = 3 THEN 'market_signal_detected' WHEN event_id % 11 = 7 THEN 'trend_spike_detected' " + " ".join(
    f"WHEN event_type = '{k}' THEN '{v}'" for k, v in EVENT_TYPES.items()
) + " END"

VIEWS = {
    "articles": """
SELECT doc_id AS id, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS source_id,
  'https://news.example.com/' || lang || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '?utm_source=x&id=' || doc_id WHEN 1 THEN '/'
    WHEN 2 THEN '#top' ELSE '' END AS url,
  substring(split_part(text, chr(10), 1), 1, 500) AS title, text AS content,
  CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE substring(text, 1, 120) END AS summary,
  'author' || (doc_id % 17) AS author,
  TIMESTAMP '2025-12-31 00:00:00' + to_minutes(doc_id * 7) AS published_at,
  TIMESTAMP '2025-12-31 00:00:00' + to_minutes(doc_id * 7 + doc_id % 30) AS crawled_at,
  lang AS category, CAST(NULL AS DOUBLE) AS sentiment_score,
  CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '{}'
    WHEN 2 THEN '{"nlp_processed":true,"vision_processed":true,"images":["https://img.example.com/a' || doc_id || '.png"]}'
    WHEN 3 THEN '{"nlp_processed":false,"images":["https://img.example.com/b' || doc_id || '.png","https://img.example.com/icon.png"]}'
    ELSE '{"nlp_processed":true,"nlp_error":"timeout","images":[]}' END AS metadata
FROM documents""",
    "crawl_sources": """
SELECT CAST(s_suppkey AS INTEGER) AS id, s_name AS name, 'https://s' || s_suppkey || '.example.com' AS base_url,
  CASE s_nationkey % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'community' ELSE 'market_feed_site' END AS category,
  CAST(10 + s_suppkey % 3 * 5 AS INTEGER) AS crawl_interval_minutes, s_acctbal >= 0 AS is_active,
  CASE s_suppkey % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{"collector_type":"us_market_signal","target_url_or_query":"fed"}'
    WHEN 2 THEN '{"collector_type":"target_site","target_url":"https://feed.example.com/' || s_suppkey || '","feed_category":"macro"}'
    ELSE NULL END AS ai_parsing_hints
FROM supplier""",
    "crawl_events": f"""
SELECT event_id AS id, CAST(user_id AS INTEGER) AS source_id, {_EVENT_CASE} AS event_type, 'event ' || event_id AS title,
  'https://s' || user_id || '.example.com/' || (props->>'$.k') AS url, props AS details, ts AS created_at
FROM events""",
    "feedbacks": """
SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, CAST(props->>'$.k' AS BIGINT) AS article_id,
  CASE WHEN event_type = 'click' THEN 'click' ELSE 'impression' END AS event_type, ts AS created_at
FROM events WHERE event_type IN ('view', 'click')""",
    "comments": """
SELECT conv_id AS article_id, conv_id || '_' || turn AS comment_ext_id, role AS author, text AS content,
  CAST(length(text) % 100 AS INTEGER) AS score, CAST(turn AS INTEGER) AS depth,
  TIMESTAMP '2025-12-31 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS published_at
FROM conversations""",
    "article_images": """
SELECT p_partkey AS id, p_partkey // 4 AS article_id, 'https://img.example.com/' || p_partkey || '.png' AS image_url,
  CAST(p_partkey % 4 + 1 AS INTEGER) AS order_index,
  '{{IMG:' || (p_partkey % 4 + 1) || ':https://img.example.com/' || p_partkey || '.png}}' AS placeholder_token,
  CASE p_size % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'COMPLETED' ELSE 'FAILED' END AS status,
  p_name AS description
FROM part""",
    "stock_daily": """
SELECT CAST(l_shipdate AS DATE) AS target_dt, p_brand AS code, 'Name ' || p_brand AS name,
  first(piece ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS open_price,
  max(piece) AS high_price, min(piece) AS low_price,
  first(piece ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS close_price,
  CAST(sum(qty) AS BIGINT) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount,
  CAST(sum(CASE WHEN l_suppkey % 2 = 0 THEN qty ELSE -qty END) AS BIGINT) AS foreigner,
  CAST(sum(CASE WHEN l_suppkey % 3 = 0 THEN qty ELSE -qty END) AS BIGINT) AS institution
FROM (SELECT *, CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS piece, CAST(l_quantity AS BIGINT) AS qty
      FROM lineitem JOIN part ON l_partkey = p_partkey) q
GROUP BY 1, 2""",
    "stock_snapshot": """
SELECT target_dt, code, name, close_price AS close, volume, amount,
  CAST(close_price - open_price AS DOUBLE) / open_price * 100.0 AS change_ratio
FROM stock_daily""",
}
_NEEDS = {"stock_snapshot": ("stock_daily",)}


def with_views(*names: str) -> str:
    """A WITH clause that defines the named stand-in tables (and what they need), without a trailing comma."""
    ordered: list[str] = []
    for name in names:
        for n in (*_NEEDS.get(name, ()), name):
            if n not in ordered:
                ordered.append(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
