"""Reading Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. How many tasks read it is up to the session (``spark.sql.files.maxPartitionBytes``, ``minPartitionNum``)."""
    return spark.read.parquet(path)
