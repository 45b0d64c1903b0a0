"""Registry of runnable queries: a name, a function (spark, sf_dir) -> DataFrame and, where SQL can say it, the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def day(c: str | Column) -> Column:
    """A date as text, so that both engines print it alike."""
    return F.date_format(c, "yyyy-MM-dd")


def stamp(c: str | Column) -> Column:
    """A timestamp as text to the second."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def listed(c: str | Column) -> Column:
    """An array of strings as one text."""
    return F.array_join(c, "|")
