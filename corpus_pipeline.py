"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

Every stage but the last returns the columns of ``documents``, of the documents that it keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mistveil.llm import mixing, neardup, packing, pii, repetition
from mistveil.llm.common import Scratch, bounded_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep.

    Null and empty texts have fewer words than the rules ask for and go; long ones are measured whole. Every row is judged by
    itself, so repeated rows and rows without a doc_id are kept or go alike. Columns beside those of documents are dropped.
    """
    bounded_batches(spark)
    return repetition.keep(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates (five-word shingles, similarity 0.8).

    Rows without a doc_id come behind all others, and of rows that share one the smaller hash of the text comes first; each
    is a document of its own, so one row of a group stays whatever its ids are. Texts without words (or null) are alike with
    nothing and stay.
    """
    scratch = Scratch(spark, "dedup-stage")
    docs = docs.select(*COLUMNS)
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        found = neardup.near_duplicates(spark, docs, neardup.SHINGLE, neardup.PERCENT)
        return docs.join(scratch.save(found.where("kept").select("doc_id"), "kept"), "doc_id", "left_semi").select(*COLUMNS)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    numbered = scratch.save(docs.orderBy(*order).withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = neardup.near_duplicates(spark, numbered.select(F.col("row").alias("doc_id"), "text"), neardup.SHINGLE, neardup.PERCENT)
    kept = scratch.save(found.where("kept").select(F.col("doc_id").alias("row")), "kept")
    return numbered.join(kept, "row", "left_semi").select(*COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted again.

    Null texts stay as they are; empty and long ones, repeated rows and rows without a doc_id are treated as any other.
    """
    bounded_batches(spark)
    return pii.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them; copies are rows with the same values.

    Null sources and such as have no weight keep each row once. Null and empty texts count as no characters of their
    source but are drawn. Repeated rows draw the same count, rows without a doc_id draw by their text.
    """
    return mixing.mix(docs.select(*COLUMNS), mixing.WEIGHTS).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens.

    Null and empty texts are the end token alone, long ones are cut. Every row is packed, also repeated ones and those
    without a doc_id; which of equally long pieces goes where follows the order of rows.
    """
    return packing.pack(spark, docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("redact_pii", redact_pii), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: Tokens cannot be computed in SQL; tests/llm compares the rows of every stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
