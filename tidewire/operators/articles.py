"""Article lists, searches, work queues, deduplication, comments and captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.core import json_flag, json_length, json_text
from tidewire.functions.urls import canonical_url
from tidewire.operators.keys import first_per_key, top_per
from tidewire.operators.sinks import merge_json

# Page size limit, caption wording of the queue and of the worker.
MAX_PAGE = 100
CAPTION = ("\n\n[🖼️ 첨부 이미지 #", " 내용: ", "]\n\n")
IMAGE_BLOCK, DOWNLOAD_FAILED, WORKER_IMAGES = ("\n\n", "[이미지 ", " 설명: ", "]"), "이미지 다운로드 실패", 3
UNKNOWN_AUTHOR = "익명"
IMAGE_STATES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")
MIN_EXTRACTED, MIN_BACKFILLED, MIN_ANCHOR = 10, 30, 2


def filter_articles(articles: DataFrame, source_id: int | None = None, category: str | None = None) -> DataFrame:
    """Optional equality filters (F1); 0 and '' mean no filter."""
    rows = articles
    if source_id:
        rows = rows.where(F.col("source_id") == source_id)
    if category:
        rows = rows.where(F.col("category") == category)
    return rows


def search_articles(articles: DataFrame, keyword: str, literal: bool = False) -> DataFrame:
    """Articles whose title or content contains the keyword, ignoring case (F2).

    "%" and "_" in the keyword act as wildcards unless ``literal`` is set.
    """
    if len(keyword) < 2:
        raise ValueError("a search needs at least two characters")
    if literal:
        low = F.lit(keyword.lower())
        return articles.where(F.contains(F.lower("title"), low) | F.contains(F.lower("content"), low))
    return articles.where(F.col("title").ilike(f"%{keyword}%") | F.col("content").ilike(f"%{keyword}%"))


def paginate(rows: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """One page, newest id first."""
    if not 1 <= size <= MAX_PAGE:
        raise ValueError(f"page size must be 1..{MAX_PAGE}")
    return rows.orderBy(F.desc("id")).offset((page - 1) * size).limit(size)


def page_before(rows: DataFrame, before_id: int | None = None, size: int = 20) -> DataFrame:
    """The page after the row ``before_id``, newest id first (T1): a filter and a top list, so that a deep page holds no more rows than the first."""
    if not 1 <= size <= MAX_PAGE:
        raise ValueError(f"page size must be 1..{MAX_PAGE}")
    rows = rows if before_id is None else rows.where(F.col("id") < before_id)
    return rows.orderBy(F.desc("id")).limit(size)


def total(rows: DataFrame) -> DataFrame:
    """The row count that goes with a page."""
    return rows.agg(F.count("*").alias("total"))


def get_by_id(rows: DataFrame, key: int) -> DataFrame:
    return rows.where(F.col("id") == key)


def keep_content(rows: DataFrame, column: str, min_len: int) -> DataFrame:
    """Quality gate by length."""
    return rows.where(F.length(column) >= min_len)


def needs_text(skip_failed: bool = False) -> Column:
    """Text analysis is pending: no summary or not marked as done. ``skip_failed`` leaves out articles whose analysis has failed."""
    empty = F.col("summary").isNull() | (F.col("summary") == "")
    pending = empty | ~json_flag("metadata", "nlp_processed")
    return pending & json_text("metadata", "nlp_error").isNull() if skip_failed else pending


def needs_images() -> Column:
    """Image analysis is pending: images are listed and not marked as done."""
    return (json_length("metadata", "images") > 0) & ~json_flag("metadata", "vision_processed")


def pending_text(articles: DataFrame, n: int = 8, skip_failed: bool = False) -> DataFrame:
    """The next ``n`` articles to analyse, newest first, no url and no title twice.

    A row is taken when neither its url nor its title was taken before; nulls count as one url, and as an empty title. Only the newest ``n`` urls of a title and ``n`` titles of a url can be
    taken: whoever stands behind them comes after ``n`` taken rows. Each taken row then shuts out fewer than 2n others, so that the newest 2n * n of what is left decide. They are folded in one row.
    """
    cols = ["id", "source_id", "url", "title", "published_at"]
    rows = articles.where(needs_text(skip_failed)).select(*cols, F.coalesce("title", F.lit("")).alias("__title"))
    newest = [F.desc("published_at"), F.desc("id")]
    of_title = top_per(top_per(rows, ["url", "__title"], newest), ["__title"], newest, n)
    head = top_per(of_title, ["url"], newest, n).orderBy(*newest).limit(2 * n * n)
    queue = head.agg(F.sort_array(F.collect_list(F.struct("published_at", "id", "source_id", "url", "title", "__title")), asc=False).alias("queue"))
    free = lambda taken, r: ~F.exists(taken, lambda t: t["url"].eqNullSafe(r["url"]) | (t["__title"] == r["__title"]))
    taken = F.aggregate("queue", F.slice("queue", 1, 0), lambda taken, r: F.when((F.size(taken) < n) & free(taken, r), F.concat(taken, F.array(r))).otherwise(taken))
    return queue.select(F.inline(taken)).select(*cols)


def pending_images(articles: DataFrame, n: int = 4) -> DataFrame:
    """The next ``n`` articles with unprocessed images."""
    cols = ["id", "source_id", "url", "title", "published_at", "metadata"]
    return articles.where(needs_images()).select(*cols).orderBy(F.desc("published_at"), F.desc("id")).limit(n)


def pending_counts(articles: DataFrame, skip_failed: bool = False) -> DataFrame:
    """All, text-pending and image-pending articles in one pass."""
    return articles.agg(
        F.count("*").alias("total"), F.count_if(needs_text(skip_failed)).alias("text_pending"), F.count_if(needs_images()).alias("vision_pending")
    )


def queue_stats(images: DataFrame) -> DataFrame:
    """Images per state and in all."""
    return images.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in IMAGE_STATES], F.count("*").alias("total"))


def collectors(sources: DataFrame, kind: str | None = None) -> DataFrame:
    """Sources with their collector settings out of JSON (F9), newest first; None or "all" means every kind."""
    hint = lambda key: json_text("ai_parsing_hints", key)
    rows = sources.select(
        "id", "name", F.coalesce(hint("collector_type"), F.lit("rule_seed")).alias("collector_type"),
        F.coalesce(hint("target_url_or_query"), F.col("base_url")).alias("target"),
        "base_url", "category", "crawl_interval_minutes", "is_active",
    )
    return rows if not kind or kind == "all" else rows.where(F.col("collector_type") == kind)


def custom_entries(sources: DataFrame, category: str, kind: str) -> DataFrame:
    """User-made catalog rows: by category column or by the JSON collector type."""
    return sources.where((F.col("category") == category) | F.coalesce(json_text("ai_parsing_hints", "collector_type") == kind, F.lit(False)))


def catalog(builtin: DataFrame, sources: DataFrame, category: str, kind: str) -> DataFrame:
    """Built-in entries and user-made ones with the same columns (U1); ``rank`` keeps built-in rows first."""
    hint = lambda key, default: F.coalesce(json_text("ai_parsing_hints", key), default)
    custom = custom_entries(sources, category, kind).select(
        F.col("id").cast("string").alias("id"), "name", hint("target_url", F.col("base_url")).alias("url"),
        hint("feed_category", F.lit("us_market")).alias("category"), "is_active", hint("description", F.lit("")).alias("description"),
        F.lit(False).alias("is_builtin"), F.lit(1).alias("rank"),
    )
    return builtin.withColumns({"is_builtin": F.lit(True), "rank": F.lit(0)}).unionByName(custom)


def new_urls(candidates: DataFrame, stored: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Candidate links that are not stored yet, one per canonical URL, first position wins.

    Every stored URL counts in its raw and canonical form, so one anti join on the canonical form covers both checks.
    Candidates are reduced to one row per canonical URL before that join.
    """
    cand = candidates.where(F.coalesce("url", F.lit("")) != "").withColumn("canonical", canonical_url("url"))
    known = stored.select(F.explode(F.array_distinct(F.array(canonical_url("url"), F.col("url")))).alias("canonical")).distinct()
    fresh = first_per_key(cand, ["canonical"], "pos").join(known, "canonical", "left_anti")
    return fresh.select(*(keep or candidates.columns))


def cap_per_source(links: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` links of every source."""
    return top_per(links, ["source_id"], [F.asc("pos")], n)


def mark_new(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates with a flag that says whether ``new_urls`` keeps them; input of ``events.scan_summary``."""
    fresh = new_urls(candidates, stored, ["pos"]).withColumn("is_new", F.lit(True))
    return candidates.join(fresh, "pos", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


def propagate_by_title(articles: DataFrame, enriched: DataFrame) -> DataFrame:
    """Fill rows without a summary from the latest enriched article of the same title.

    ``enriched`` has title, summary, sentiment_score, patch and published_at. It is reduced to one donor per title, so
    a title with very many copies meets a single row and adaptive execution can split its side of the join.
    """
    donor = enriched.where(F.coalesce("title", F.lit("")) != "").groupBy("title").agg(
        F.max_by(F.struct("summary", "sentiment_score", "patch"), F.struct("published_at", "summary")).alias("__d")
    )
    empty = F.col("summary").isNull() | (F.col("summary") == "")
    hit = empty & F.col("__d").isNotNull()
    new = {
        "summary": F.when(hit, F.coalesce("__d.summary", F.lit(""))).otherwise(F.col("summary")),
        "sentiment_score": F.when(hit, F.col("__d.sentiment_score")).otherwise(F.col("sentiment_score")),
        "metadata": F.when(hit, merge_json(F.col("metadata"), F.col("__d.patch"))).otherwise(F.col("metadata")),
    }
    return articles.join(donor, "title", "left").select(*[new.get(c, F.col(c)).alias(c) for c in articles.columns])


def comment_parent(comments: DataFrame, articles: DataFrame) -> DataFrame:
    """Comments with the id of the newest article row of their url."""
    newest = articles.groupBy("url").agg(F.max_by("id", F.struct("published_at", "id")).alias("article_id"))
    return comments.join(newest, "url")


def _listed_comments(metadata: Column) -> Column:
    shape = (
        "array<struct<comment_ext_id: string, author: string, content: string, score: int, depth: int, published_at: string>>"
    )
    return F.from_json(json_text(metadata, "top_comments"), shape)


def comments_of(comments: DataFrame, articles: DataFrame, article_id: int | None = None, n: int = 30) -> DataFrame:
    """Comments of one or of all articles (J7): the best ``n`` stored ones, else those listed in the article's JSON."""
    if article_id is not None:
        comments, articles = comments.where(F.col("article_id") == article_id), articles.where(F.col("id") == article_id)
    stored = top_comments(comments, n).select(
        "article_id", "comment_ext_id", F.coalesce("author", F.lit(UNKNOWN_AUTHOR)).alias("author"), "content",
        F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )
    with_rows = comments.select(F.col("article_id").alias("id")).distinct()
    c = F.col("c")
    listed = (
        articles.select("id", "metadata")
        .join(with_rows, "id", "left_anti")
        .select("id", F.posexplode(_listed_comments(F.col("metadata"))).alias("pos", "c"))
        .select(
            F.col("id").alias("article_id"),
            F.coalesce(c["comment_ext_id"], F.concat(F.lit("c_"), F.col("pos").cast("string"))).alias("comment_ext_id"),
            F.coalesce(c["author"], F.lit(UNKNOWN_AUTHOR)).alias("author"),
            F.coalesce(c["content"], F.lit("")).alias("content"),
            F.coalesce(c["score"], F.lit(0)).alias("score"),
            F.coalesce(c["depth"], F.lit(0)).alias("depth"),
        )
    )
    return stored.unionByName(listed)


def top_comments(comments: DataFrame, n: int) -> DataFrame:
    """The best ``n`` comments of every article (T4): score, then newest."""
    return top_per(comments, ["article_id"], [F.desc("score"), F.desc("published_at"), F.asc("comment_ext_id")], n)


def comment_summary(comments: DataFrame, crawled_at: Column, n: int = 5) -> DataFrame:
    """Per article the best comments, their number and the last crawl as a JSON patch.

    The list is built from ``n`` rows per article; the count is a separate partial aggregation.
    """
    best = top_comments(comments, n)
    order = F.struct((-F.col("score")).alias("s"), (-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("p"), "comment_ext_id", "author", "content", "score")
    lists = best.groupBy("article_id").agg(F.array_sort(F.collect_list(order)).alias("best"))
    counts = comments.groupBy("article_id").agg(F.count("*").alias("comment_count"))
    brief = F.transform("best", lambda c: F.struct(c["comment_ext_id"].alias("comment_ext_id"), c["author"].alias("author"), c["content"].alias("content"), c["score"].alias("score")))
    patch = F.to_json(
        F.struct(brief.alias("top_comments"), F.col("comment_count"), F.date_format(crawled_at, "yyyy-MM-dd'T'HH:mm:ss").alias("last_comment_crawled_at"))
    )
    return counts.join(lists, "article_id").select("article_id", "comment_count", F.transform("best", lambda c: c["comment_ext_id"]).alias("top_ids"), patch.alias("patch"))


def inject_captions(articles: DataFrame, images: DataFrame, max_images: int | None = None) -> DataFrame:
    """Put finished image captions into the content.

    A caption replaces its placeholder, or goes to the end when the placeholder is absent, in image order.
    All images of the queue count; ``max_images`` takes the first ones of an article.
    """
    done = images.where((F.col("status") == "COMPLETED") & (F.coalesce("description", F.lit("")) != ""))
    if max_images is not None:
        done = top_per(done, ["article_id"], [F.asc("order_index"), F.asc("id")], max_images)
    head, middle, tail = CAPTION
    text = F.concat(F.lit(head), F.col("order_index").cast("string"), F.lit(middle), F.col("description"), F.lit(tail))
    captions = done.groupBy(F.col("article_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("order_index", F.col("id").alias("image_id"), F.col("placeholder_token").alias("token"), text.alias("text")))).alias("captions")
    )
    merged = F.aggregate(
        "captions",
        F.col("content"),
        lambda acc, c: F.when(F.contains(acc, c["token"]), F.replace(acc, c["token"], c["text"])).otherwise(F.concat(acc, c["text"])),
    )
    return articles.join(captions, "id", "left").withColumn("content", F.when(F.col("captions").isNull(), F.col("content")).otherwise(merged)).drop("captions")


def append_caption_block(articles: DataFrame, described: DataFrame, model: str, at: Column) -> DataFrame:
    """The worker's captions: one block of lines at the end of the content, once, and the outcome of each image in the metadata.

    ``articles`` has id, content and metadata; ``described`` has id, order_index (from 0, as listed), image_url, status, description and error. Only
    the first three listed images of an article count; a repeated place counts once. An image without success, or with a failed download, has no line.
    """
    gap, head, middle, tail = IMAGE_BLOCK
    good = (F.col("status") == "success") & (F.coalesce("description", F.lit("")) != "") & ~F.startswith("description", F.lit(DOWNLOAD_FAILED))
    line = F.when(good, F.concat(F.lit(head), (F.col("order_index") + 1).cast("string"), F.lit(middle), F.col("description"), F.lit(tail)))
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    outcome = F.struct(
        F.col("image_url").alias("url"), F.when(good, F.col("description")).alias("caption"), F.when(good, stamp).alias("injected_at"), F.when(good, F.lit(model)).alias("model_used"), F.when(~F.coalesce(good, F.lit(False)), F.col("error")).alias("error")
    )
    rows = described.where((F.col("order_index") < WORKER_IMAGES) & (F.coalesce("image_url", F.lit("")) != "")).groupBy("id", "order_index").agg(F.min(F.struct(line.alias("line"), outcome.alias("outcome"))).alias("v"))
    per = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("order_index", "v"))).alias("images"))
    lines = F.array_compact(F.transform("images", lambda i: i["v"]["line"]))
    block = F.concat(F.lit(gap), F.array_join(lines, "\n"))
    content = F.when((F.size(lines) > 0) & ~F.contains("content", block), F.concat("content", block)).otherwise(F.col("content"))
    patch = F.to_json(F.struct(F.lit(True).alias("vision_processed"), F.lit(model).alias("vision_model"), stamp.alias("vision_processed_at"), F.transform("images", lambda i: i["v"]["outcome"]).alias("images")))
    new = {"content": content, "metadata": merge_json(F.col("metadata"), patch)}
    return articles.join(per, "id", "left").select(*[F.when(F.col("images").isNull(), F.col(c)).otherwise(new[c]).alias(c) if c in new else F.col(c) for c in articles.columns])
