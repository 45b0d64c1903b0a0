"""Markup-related column expressions: tags, selectors, image lists, model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.core import ColumnLike, as_col
from tidewire.functions.text import strip

# Image URLs containing one of these are page furniture.
FURNITURE = (
    "gif_load", "loading", "icon", "btn", "logo", "banner", "ad.", "emoji", "emoticon", "drag",
    "photo_drag", "blank.gif", "dot.gif", "transparent.gif", "clear.gif",
)
# File names that do not identify an author.
ANONYMOUS_FILES = ("blank", "default", "icon", "anonymous")
# Signs that a "selector" is really prose.
PROSE_STARTS = ("/*", "//", "# ")
PROSE_MARKS = ("warning", "cannot", "not determined", "not found", "provided dom")
PROSE_WORDS = ("the", "this", "selector", "contains", "element")
PROSE_MIN_WORDS = 7

# Fields of a model's answer.
MODEL_SCHEMA = (
    "summary string, sentiment_score string, sentiment_label string, "
    "key_topics string, entities string, related_stocks string"
)


def any_of(text: Column, needles: tuple[str, ...]) -> Column:
    """True when the text contains one of a fixed, short list of needles."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(text, F.lit(needle))
    return hit


def strip_tags(html: ColumnLike) -> Column:
    """Text of a markup fragment, with one blank between pieces."""
    no_code = F.regexp_replace(as_col(html), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no_code, r"(?s)<[^>]*>", " "), r"\s+", " "))


def selector_clean(c: ColumnLike) -> Column:
    """A selector written by a model, or '' when it is a comment, a message or prose."""
    s = F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"^[\s`'\"]+|[\s`'\"]+$", "")
    low = F.lower(s)
    comment = F.lit(False)
    for start in PROSE_STARTS:
        comment = comment | F.startswith(s, F.lit(start))
    words = F.size(F.split(s, r"\s+"))
    prose = (words > PROSE_MIN_WORDS) & any_of(low, PROSE_WORDS)
    bad = comment | any_of(low, PROSE_MARKS) | F.contains(s, F.lit("\n")) | prose
    return F.when(bad, F.lit("")).otherwise(s)


def content_images(urls: ColumnLike) -> Column:
    """Image URLs without icons, buttons and other page furniture; order kept."""
    return F.filter(as_col(urls), lambda u: u.isNotNull() & (u != "") & ~any_of(F.lower(u), FURNITURE))


def image_tokens(urls: ColumnLike, prefix: str = "IMG") -> Column:
    """One placeholder per content image, carrying its 1-based index and its URL."""
    return F.transform(
        content_images(urls),
        lambda u, i: F.struct(
            (i + 1).alias("order_index"),
            F.concat(F.lit("{{" + prefix + ":"), (i + 1).cast("string"), F.lit(":"), u, F.lit("}}")).alias("token"),
            u.alias("image_url"),
        ),
    )


def union_images(first: ColumnLike, second: ColumnLike) -> Column:
    """Ordered union without repeats; null lists count as empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(as_col(first), empty), F.coalesce(as_col(second), empty)))


def image_author(src: ColumnLike) -> Column:
    """A stable nickname for an author who is only shown as an image."""
    src = as_col(src)
    file = F.substring_index(F.substring_index(F.substring_index(src, "/", -1), "?", 1), ".", 1)
    named = (F.length(file) >= 3) & ~any_of(F.lower(file), ANONYMOUS_FILES)
    return F.when(named, F.concat(F.lit("@"), file)).otherwise(F.concat(F.lit("@user_"), F.substring(F.md5(src), 1, 6)))


def _json_list(c: Column) -> Column:
    """A JSON array as array<string>; anything else is the empty list."""
    return F.when(F.startswith(F.ltrim(c), F.lit("[")), F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))).otherwise(
        F.array().cast("array<string>")
    )


# Fixed value: the label of an answer without one.
NEUTRAL = "중립"


def parse_model_output(raw: ColumnLike) -> Column:
    """Fields of the JSON object inside a model answer, with defaults for what is missing or mistyped.

    A think block and a code fence around the object are ignored. ``parsed`` is false when no valid object is found.
    """
    body = strip(F.regexp_replace(F.coalesce(as_col(raw), F.lit("")), r"(?s)<think>.*?</think>", ""))
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(body)
    blob = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    doc = F.from_json(F.when(blob == "", None).otherwise(blob), MODEL_SCHEMA, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json(F.when(blob == "", None).otherwise(blob)).isNotNull()

    def text(field: str, default: Column) -> Column:
        return F.coalesce(F.nullif(doc[field], F.lit("")), default)

    return F.struct(
        valid.alias("parsed"),
        text("summary", F.substring(body, 1, 300)).alias("summary"),
        F.coalesce(doc["sentiment_score"].try_cast("double"), F.lit(0.0)).alias("sentiment_score"),
        text("sentiment_label", F.lit(NEUTRAL)).alias("sentiment_label"),
        F.coalesce(_json_list(doc["key_topics"]), F.array().cast("array<string>")).alias("key_topics"),
        F.coalesce(_json_list(doc["entities"]), F.array().cast("array<string>")).alias("entities"),
        F.coalesce(_json_list(doc["related_stocks"]), F.array().cast("array<string>")).alias("related_stocks"),
    )
