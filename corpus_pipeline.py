"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir), docs being a table read from files, and works on all rows that its predecessor kept; all but the last
return the columns of documents. Cases: a null text is scored, compared and packed as an empty one and stays null; rows with a null doc_id are no near
duplicates and pass that stage, all others treat them like any row; rows with one doc_id are one document to near_dedup and stay or go together;
empty tables, empty and very long texts pass through every stage.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultspark.llm import decontam, near_dedup, packing, pii, quality
from faultspark.llm.common import blocks, crc_mod, spread, staged, table

REJECT_BELOW = 0.5  # under the operator's threshold of 0.7: a filter should keep what is more likely good than not


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not score under REJECT_BELOW."""
    train = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 4) != 2)
    shipped = spark.sparkContext.broadcast(quality.fit(docs, train))

    def run(batches):
        own = shipped.value
        for b in batches:
            keep = [s >= REJECT_BELOW for _, t in blocks(b.column("text")) for s in own.scores(t)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies (five-word shingles, similarity 0.8)."""
    gone = near_dedup.near_duplicates(docs, shingle=5).where("not kept").select("doc_id").distinct()
    return docs.join(staged(gone, "copies"), "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, row by row: docs is a written table, whose rows keep their numbers."""
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    leaks = decontam.contaminated(numbered.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return numbered.join(staged(leaks.select(F.col("doc_id").alias("_row")).distinct(), "leaks"), "_row", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The stages train a model, tokenize and bootstrap: SQL can't express them; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
