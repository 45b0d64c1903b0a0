"""The corpus pipeline: quality rules, toxicity, near duplicates, benchmark passages, packing. Each stage works on all that the one before it kept.

Every stage but the last returns the columns of ``documents``. Rows without an id pass the stages that judge a row by itself, and the grouping stage leaves them alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, packing, quality, simhash, toxicity
from tidewire.llm.common import only, rest_of_crc, stored, table, without


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no certified rule rejects; the cutoffs come from the labelled ones among them."""
    cutoffs = quality.choose_cutoffs(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, cutoffs).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic is below a half."""
    index = toxicity.learn(docs, table(spark, sf_dir, "labels").where(rest_of_crc("doc_id", 5) != 0))
    return toxicity.score(docs, index, below=0.5)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the smallest by id, then by a hash of the text. Rows with one id are judged by their own texts, and one of wholly equal rows stays."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    found = stored(simhash.near_duplicate_rows(docs).select(F.struct("doc_id", "tie").alias(row), "is_first"), "copies-rows")
    keyed = docs.withColumn(row, F.struct(F.col("doc_id").cast("long").alias("doc_id"), simhash.row_tie().alias("tie")))
    left = without(keyed, found.where("NOT is_first").select(row).distinct(), row)
    equal = stored(found.where("is_first").groupBy(row).count().where("count > 1").select(row), "copies-equal")
    if not equal.isEmpty():
        left = without(left, equal, row).unionByName(only(left, equal, row).dropDuplicates([row]).select(row, *docs.columns))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all that is left."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [("quality rules", keep_good), ("toxicity", keep_civil), ("near duplicates", keep_one_copy), ("benchmark passages", keep_unseen), ("packing", pack)]

#: Certified cutoffs, nearest neighbours, bit tries and packing are beyond SQL; each stage is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs, name.replace(" ", "-")) if k + 1 < len(STAGES) else docs
    return docs
