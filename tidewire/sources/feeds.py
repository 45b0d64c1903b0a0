"""Feed, listing and embedded-post documents as tables. All parsing is done by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.core import ellipsis, epoch_seconds, from_epoch, let, ts_literal
from tidewire.functions.markup import strip_tags
from tidewire.functions.signals import extract_tickers, post_velocity

# Publisher names used when a feed names none.
RSS_PUBLISHER, ATOM_PUBLISHER = "Global Financial Wire", "Target Feed"
# An entry without a link points to its feed.
SELF_LINK = "."
REMOVED_BODIES = ("", "[deleted]", "[removed]")

RSS_SCHEMA = (
    "channel struct<item: array<struct<title: string, link: string, pubDate: string, description: string, "
    "source: struct<_VALUE: string, _url: string>>>>"
)
ATOM_SCHEMA = (
    "entry array<struct<title: struct<_VALUE: string, _type: string>, link: array<struct<_href: string, _VALUE: string>>, "
    "summary: struct<_VALUE: string, _type: string>, content: struct<_VALUE: string, _type: string>>>, "
    "item array<struct<title: struct<_VALUE: string, _type: string>, link: array<struct<_href: string, _VALUE: string>>, "
    "summary: struct<_VALUE: string, _type: string>, content: struct<_VALUE: string, _type: string>, description: string>>"
)
LISTING_SCHEMA = (
    "data struct<children: array<struct<data: struct<title: string, permalink: string, author: string, score: long, "
    "num_comments: long, upvote_ratio: double, selftext: string, stickied: boolean, created_utc: double, link_flair_text: string>>>>"
)
COMMENTS_SCHEMA = (
    "array<struct<data: struct<children: array<struct<data: struct<id: string, author: string, body: string, score: long, "
    "depth: long, created_utc: double>>>>>>"
)


def parse_feed_date(c: Column) -> Column:
    """An RFC-822 date as UTC wall time; null when it cannot be read."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    at = F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")))
    return F.convert_timezone(None, F.lit("UTC"), at.cast("timestamp_ntz"))


def _rss_items(max_per_feed: int, publisher: str) -> Column:
    """The first items of an RSS body as an array of uniform entries; null when the body is no RSS."""
    items = F.from_xml("body", RSS_SCHEMA, {"ignoreNamespace": "true"})["channel"]["item"]
    return F.transform(
        F.slice(items, 1, max_per_feed),
        lambda e, i: F.struct(
            i.alias("pos"),
            F.coalesce(e["title"], F.lit("")).alias("title"),
            F.coalesce(e["link"], F.lit("")).alias("url"),
            F.coalesce(F.nullif(e["source"]["_VALUE"], F.lit("")), F.lit(publisher or RSS_PUBLISHER)).alias("publisher"),
            F.coalesce(e["pubDate"], F.lit("")).alias("date_text"),
            F.coalesce(e["description"], F.lit("")).alias("body"),
        ),
    )


def _atom_entries(max_per_feed: int, publisher: str) -> Column:
    """The first entries of an Atom body that have a title or a link, in the same shape."""

    def entry(e: Column, i: Column, more: str | None = None) -> Column:
        link = F.get(e["link"], F.lit(0))
        href = F.trim(F.coalesce(F.nullif(link["_href"], F.lit("")), link["_VALUE"], F.lit("")))
        return F.struct(
            i.alias("pos"),
            F.trim(F.coalesce(e["title"]["_VALUE"], F.lit(""))).alias("title"),
            F.coalesce(F.nullif(href, F.lit("")), F.lit(SELF_LINK)).alias("url"),
            F.lit(publisher or ATOM_PUBLISHER).alias("publisher"),
            F.lit("").alias("date_text"),
            F.coalesce(e["summary"]["_VALUE"], e["content"]["_VALUE"], *([e[more]] if more else []), F.lit("")).alias("body"),
        )

    # a body has entries or bare items (RSS 1.0 keeps them beside the channel); both in one pass, entries first
    def listed(doc: Column) -> Column:
        entries = F.transform(F.slice(doc["entry"], 1, max_per_feed), lambda e, i: entry(e, i))
        items = F.transform(F.slice(doc["item"], 1, max_per_feed), lambda e, i: entry(e, i, "description"))
        return F.slice(F.concat(F.coalesce(entries, F.array()), F.coalesce(items, F.array())), 1, max_per_feed)

    return F.filter(let(F.from_xml("body", ATOM_SCHEMA, {"ignoreNamespace": "true"}), listed), lambda e: (e["title"] != "") | (e["url"] != SELF_LINK))


def _rows(feed_docs: DataFrame, entries: Column) -> DataFrame:
    """One row per entry. Each document is one row, so nothing is shuffled and every body is parsed once."""
    rows = feed_docs.select("feed_url", "as_of", F.explode_outer(entries).alias("e")).where(F.col("e").isNotNull())
    return rows.select(
        "feed_url",
        "e.pos",
        "e.title",
        F.when(F.col("e.url") == SELF_LINK, F.col("feed_url")).otherwise(F.col("e.url")).alias("url"),
        "e.publisher",
        F.coalesce(parse_feed_date(F.nullif(F.col("e.date_text"), F.lit(""))), F.col("as_of")).alias("published_at"),
        ellipsis(strip_tags("e.body"), 250).alias("summary"),
    )


def feed_items(feed_docs: DataFrame, max_per_feed: int = 15, publisher: str = "") -> DataFrame:
    """Rows of RSS documents (S3): the first items of each feed in document order.

    ``feed_docs`` has feed_url, body and as_of. A date that cannot be read becomes ``as_of``.
    """
    return _rows(feed_docs, _rss_items(max_per_feed, publisher))


def feed_entries(feed_docs: DataFrame, max_per_feed: int = 15, publisher: str = "") -> DataFrame:
    """Rows of Atom documents (S4): entries need a title or a link, and the time is always ``as_of``."""
    return _rows(feed_docs, _atom_entries(max_per_feed, publisher))


def feed_rows(feed_docs: DataFrame, max_per_feed: int = 15, publisher: str = "") -> DataFrame:
    """RSS rows, and Atom rows for the documents that hold no RSS item. Decided per document, in one pass."""
    rss, atom = _rss_items(max_per_feed, publisher), _atom_entries(max_per_feed, publisher)
    return _rows(feed_docs, let(rss, lambda found: F.when(F.size(F.coalesce(found, F.slice(atom, 1, 0))) > 0, found).otherwise(atom)))


def listing_posts(json_docs: DataFrame, site: str = "https://www.reddit.com", multiplier: float = 1.5) -> DataFrame:
    """Posts of forum listings (S5) with velocity and symbols; ``json_docs`` has board, body and as_of."""
    p = F.col("post")
    created = F.coalesce(p["created_utc"], epoch_seconds("as_of").cast("double"))
    hours = (epoch_seconds("as_of").cast("double") - created) / 3600.0
    score, replies = F.coalesce(p["score"], F.lit(0)), F.coalesce(p["num_comments"], F.lit(0))
    body = F.coalesce(p["selftext"], F.lit(""))
    title = F.coalesce(p["title"], F.lit(""))
    return (
        json_docs.select("board", "as_of", F.posexplode(F.from_json("body", LISTING_SCHEMA)["data"]["children"]).alias("pos", "child"))
        .select("board", "as_of", "pos", F.col("child.data").alias("post"))
        .where(~F.coalesce(p["stickied"], F.lit(False)))
        .select(
            F.concat(F.lit("r/"), F.col("board")).alias("board"),
            "pos",
            title.alias("title"),
            F.concat(F.lit(site), F.coalesce(p["permalink"], F.lit(""))).alias("url"),
            F.concat(F.lit("u/"), F.coalesce(p["author"], F.lit("unknown"))).alias("author"),
            score.alias("score"),
            replies.alias("num_comments"),
            F.coalesce(p["upvote_ratio"], F.lit(1.0)).alias("upvote_ratio"),
            post_velocity(score, replies, hours, multiplier).alias("v"),
            extract_tickers(F.concat(title, F.lit(" "), body)).alias("tickers"),
            ellipsis(body, 220).alias("summary"),
            F.coalesce(F.nullif(p["link_flair_text"], F.lit("")), F.lit("Discussion")).alias("flair"),
            from_epoch(F.floor(created).cast("long")).alias("published_at"),
        )
        .select("*", "v.velocity_score", "v.is_spike", "v.hours_alive")
        .drop("v")
    )


def listing_comments(json_docs: DataFrame, n: int = 15) -> DataFrame:
    """The best ``n`` top-level comments of each thread document (S6); ``json_docs`` has post_id, body and as_of."""
    children = F.try_element_at(F.from_json("body", COMMENTS_SCHEMA), F.lit(2))["data"]["children"]
    rows = F.filter(
        F.transform(
            children,
            lambda c, i: F.struct(
                (-F.coalesce(c["data"]["score"], F.lit(0))).alias("rank_score"),
                i.alias("pos"),
                c["data"].alias("c"),
            ),
        ),
        lambda r: r["c"]["body"].isNotNull() & ~r["c"]["body"].isin(list(REMOVED_BODIES)),
    )
    c = F.col("row.c")
    return (
        json_docs.select("post_id", "as_of", F.explode(F.slice(F.array_sort(rows), 1, n)).alias("row"))
        .select(
            "post_id",
            F.concat(F.lit("t1_"), F.coalesce(c["id"], F.lit(""))).alias("comment_ext_id"),
            F.concat(F.lit("u/"), F.coalesce(c["author"], F.lit("unknown"))).alias("author"),
            c["body"].alias("content"),
            F.coalesce(c["score"], F.lit(0)).alias("score"),
            F.coalesce(c["depth"], F.lit(0)).alias("depth"),
            F.coalesce(from_epoch(F.floor(c["created_utc"]).cast("long")), F.col("as_of")).alias("published_at"),
            extract_tickers(c["body"]).alias("tickers"),
        )
    )


def embedded_posts(pages: DataFrame, as_of, n: int = 10, host: str = "https://www.threads.net") -> DataFrame:
    """Posts from JSON inside page scripts (S7): captions, codes and like counts paired by position.

    ``pages`` has page_id, username and html. The first script with captions is used.
    """
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*>(.*?)</script>"), F.lit(1))
    caption_re = F.lit(r'"text":\s*"([^"]{10,500})"')
    script = F.get(F.filter(scripts, lambda s: F.size(F.regexp_extract_all(s, caption_re, F.lit(1))) > 0), F.lit(0))
    parsed = pages.select("page_id", "username", script.alias("script")).where(F.col("script").isNotNull()).select(
        "page_id",
        "username",
        F.slice(F.regexp_extract_all("script", caption_re, F.lit(1)), 1, n).alias("captions"),
        F.regexp_extract_all("script", F.lit(r'"code":\s*"([A-Za-z0-9_-]{5,15})"'), F.lit(1)).alias("codes"),
        F.regexp_extract_all("script", F.lit(r'"like_count":\s*(\d+)'), F.lit(1)).alias("likes"),
    )
    i = F.col("pos")
    score = F.coalesce(F.get("likes", i).cast("long"), (i * 45 + 150).cast("long"))
    # JSON escapes are read by the JSON parser; a caption that it can't read keeps them
    text = F.regexp_replace(F.coalesce(F.get_json_object(F.concat(F.lit('{"c":"'), F.col("caption"), F.lit('"}')), "$.c"), F.col("caption")), r"\\n|\n", " ")
    at = ts_literal(as_of) - F.make_dt_interval(hours=i * 2 + 1)
    return parsed.select("page_id", "username", "codes", "likes", F.posexplode("captions").alias("pos", "caption")).select(
        "page_id",
        "pos",
        ellipsis(text, 80).alias("title"),
        F.concat(
            F.lit(host + "/@"), F.col("username"), F.lit("/post/"), F.coalesce(F.get("codes", i), F.concat(F.lit("thread_"), (i + 1).cast("string")))
        ).alias("url"),
        score.alias("score"),
        (F.floor(score * F.lit(15) / 100) + 10).cast("long").alias("num_comments"),
        text.alias("summary"),
        at.alias("published_at"),
    )
