"""URL normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.core import ColumnLike, as_col, let

# Tracking parameters removed from every URL.
TRACKING_PREFIX = "utm_"
TRACKING_PARAMS = ("ref", "rc", "_gl", "source", "sid", "fbclid")
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
DEFAULT_BOARD = "wallstreetbets"


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    """Form encoding that leaves "~" alone and escapes "*"."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: ColumnLike) -> Column:
    """Drop tracking parameters, blank parameters, the fragment and trailing slashes; null becomes ''."""
    raw = F.ltrim(F.translate(F.coalesce(as_col(url), F.lit("")), "\t\r\n", ""))
    no_fragment = F.substring_index(raw, "#", 1)
    base = F.substring_index(no_fragment, "?", 1)
    query = no_fragment.substr(F.length(base) + 2, F.length(no_fragment))
    scheme = F.regexp_extract(base, SCHEME, 1)
    base = F.concat(F.lower(scheme), base.substr(F.length(scheme) + 1, F.length(base)))

    def key(pair: Column) -> Column:
        return _decode(F.substring_index(pair, "=", 1))

    def value(pair: Column) -> Column:
        return _decode(pair.substr(F.length(F.substring_index(pair, "=", 1)) + 2, F.length(pair)))

    pairs = F.filter(
        F.split(query, "&"),
        lambda p: p.rlike("^[^=]*=(?s:.)") & ~F.startswith(key(p), F.lit(TRACKING_PREFIX)) & ~key(p).isin(list(TRACKING_PARAMS)),
    )
    kept = F.array_join(F.transform(pairs, lambda p: F.concat(_encode(key(p)), F.lit("="), _encode(value(p)))), "&")
    # a URL without parameters skips the work on pairs
    tail = F.when(F.contains(no_fragment, F.lit("?")), let(kept, lambda k: F.when(k == "", "").otherwise(F.concat(F.lit("?"), k)))).otherwise("")
    return F.rtrim(F.concat(base, tail), F.lit("/"))


def url_domain(url: ColumnLike) -> Column:
    """Lower-cased authority part, or "default" when there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(as_col(url), F.lit("")), AUTHORITY, 1))
    return F.when(host == "", F.lit("default")).otherwise(host)


def board_name(target: ColumnLike) -> Column:
    """Bare board name from "r/name", a full board URL or the plain name."""
    bare = F.regexp_replace(as_col(target), r"^https?://(?:www\.)?reddit\.com/", "")
    return F.regexp_replace(F.replace(bare, F.lit("r/"), F.lit("")), r"^[/ ]+|[/ ]+$", "")


def board_and_post(url: ColumnLike, target: ColumnLike | None = None) -> Column:
    """Struct (board, post_id) from a thread URL; other URLs take the board from ``target``."""
    url = as_col(url)
    parts = F.split(F.regexp_extract(url, r"reddit\.com/r/([^\n]*)", 1), "/")
    is_thread = F.contains(url, F.lit("reddit.com/r/"))
    fallback = F.coalesce(board_name(target), F.lit(DEFAULT_BOARD)) if target is not None else F.lit(DEFAULT_BOARD)
    return F.struct(
        F.when(is_thread, F.get(parts, F.lit(0))).otherwise(fallback).alias("board"),
        F.when(is_thread & (F.size(parts) >= 3) & (F.get(parts, F.lit(1)) == "comments"), F.get(parts, F.lit(2)))
        .otherwise(F.lit("recent"))
        .alias("post_id"),
    )
