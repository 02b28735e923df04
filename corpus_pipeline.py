"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what the stage before
it wrote, and returns a DataFrame.  All but the last return the columns of
``documents``.  Rows are handled as the operators' docstrings say: a null or
empty text is rejected by the first stage, rows with null doc_id are judged by
their text and never dropped as duplicates, of rows that repeat a doc_id one
stays, and an empty table passes through as an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricebench.llm import near_dedup, packing, quality_model, quality_rules
from pricebench.session import checkpoint_dir


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted of lines of their own, without the lines above the limit."""
    kept = quality_rules.keep_good(docs)
    if "n_chars" not in kept.columns:
        return kept
    return kept.withColumn("n_chars", F.expr("IF(n_chars IS NULL, NULL, length(text))").cast(kept.schema["n_chars"].dataType))


def model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer, trained on weak labels of these documents, takes for good."""
    return quality_model.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return near_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with the mixture of sources that is left."""
    return packing.pack(docs).select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", rules), ("quality classifier", model), ("near-duplicates", dedup), ("packing", pack)]

#: A trained scorer, hashed signatures and a tokenizer can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
