"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import scratch_dir

#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a checked side up to which a hash join may broadcast it (16 MB of ids).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rest_of_crc(id_column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(modulus))


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids``; the ids are broadcast only if they are counted and few, else both sides are shuffled."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, key, "left_anti")


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids``; the ids are broadcast only if they are counted and few, else both sides are shuffled."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def about(df: DataFrame, key: str, n: int) -> DataFrame:
    """All rows if there are ``n`` at most, else about ``n`` of them: those whose key's hash is small. Counted, not sorted, so that no task or driver holds more than its share."""
    total = df.count()
    if total <= n:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(1 << 40)) < F.lit(int((1 << 40) * n / total)))


#: Rows of an Arrow batch: texts are long, and a task holds some batches at a time, on both sides of the pipe to Python.
BATCH_ROWS = 2_000


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` in batches of at most BATCH_ROWS rows, unless the session has a value of its own; a task gives back its memory at its end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":  # Spark's default
        df.sparkSession.conf.set(key, str(BATCH_ROWS))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def give_back() -> None:
    """Free memory goes back to the system, where the C library can: idle workers otherwise hold it while others need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch from numpy arrays, lists or Arrow arrays, cast to the schema's types."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
