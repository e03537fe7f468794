"""From raw documents to packed training windows: five stages, each one operator of brightledger.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`; n_chars follows the text. What a stage does with nulls,
empty and very long texts, ties, repeated rows, empty tables and clashing columns is said in its operator.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from brightledger.llm import bpe, disclosure, durable, near_copies, packing, quality_rules, substrings

#: The stages learn cutoffs, count pairs and tokenise; SQL cannot express them together. tests/llm holds brute-force versions.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified rules keep."""
    return quality_rules.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 80 % of the 5-word shingles of either in common."""
    return near_copies.representatives(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier; a document of which no word is left goes."""
    return _sized(substrings.deduplicated(docs)).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))


def private_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked and disclosing terms generalised or removed."""
    return _sized(disclosure.sanitised(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of at most 1024 ids."""
    return packing.pack_documents(docs, bpe.default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("private_data", private_data_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what stands between two stages lies in the shared checkpoint folder until the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{durable.shared_folder(spark)}/pipeline-{uuid.uuid4()}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            durable.release(before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
