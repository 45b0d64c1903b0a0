"""Small column helpers shared by all modules: rounding, cutting, epochs, local-time labels, JSON access."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Fixed value: display zone is UTC+9, which has no daylight saving time.
LOCAL_OFFSET_HOURS = 9


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ts_literal(value: dt.datetime | str | Column) -> Column:
    """A zone-free timestamp from a datetime, an ISO string or a column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast("timestamp_ntz")


def round_half_up(c: ColumnLike, scale: int) -> Column:
    """Decimal half-up rounding, independent of how the double was computed."""
    return F.round(as_col(c).cast("decimal(38,10)"), scale).cast("double")


def ellipsis(c: ColumnLike, n: int) -> Column:
    """The first ``n`` characters, with "..." only when something was cut."""
    c = as_col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def full_text(title: ColumnLike, content: ColumnLike) -> Column:
    return F.concat_ws(" ", as_col(title), as_col(content))


def epoch_seconds(ts: ColumnLike) -> Column:
    """Whole seconds since 1970, counted on the zone-free clock; floors for times before 1970 too."""
    return F.floor(epoch_micros(ts) / F.lit(1_000_000)).cast("long")


def epoch_micros(ts: ColumnLike) -> Column:
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, as_col(ts).cast("timestamp_ntz"))


def from_epoch(seconds: ColumnLike) -> Column:
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", as_col(seconds), origin)


def seconds_between(start: ColumnLike, end: ColumnLike) -> Column:
    """Fractional seconds from start to end, exact to the microsecond."""
    diff = F.timestamp_diff("MICROSECOND", as_col(start), as_col(end))
    return diff.cast("double") / F.lit(1_000_000.0)


def bucket_index(epoch: ColumnLike, start: ColumnLike | int, step: int) -> Column:
    start = F.lit(start) if isinstance(start, int) else as_col(start)
    return F.floor((as_col(epoch) - start) / F.lit(step)).cast("long")


def local_time(ts: ColumnLike) -> Column:
    return F.timestamp_add("HOUR", F.lit(LOCAL_OFFSET_HOURS), as_col(ts).cast("timestamp_ntz"))


def local_label(ts: ColumnLike, fmt: str) -> Column:
    """Display label in the local zone, e.g. ``HH:mm`` or ``MM-dd HH:mm``."""
    return F.date_format(local_time(ts), fmt)


def json_text(doc: ColumnLike, key: str) -> Column:
    return F.get_json_object(as_col(doc), f"$.{key}")


def json_flag(doc: ColumnLike, key: str) -> Column:
    """A JSON boolean; missing or null counts as false."""
    return F.coalesce(json_text(doc, key).try_cast("boolean"), F.lit(False))


def json_length(doc: ColumnLike, key: str) -> Column:
    """Number of items of a JSON array; missing or not an array counts as zero."""
    return F.coalesce(F.json_array_length(json_text(doc, key)), F.lit(0))
