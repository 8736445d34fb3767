"""Texts in, masked texts out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Length in UTF-16 units from which a document is flagged as long; it is processed all the same.
LONG = 30_000
#: Characters that NFC leaves alone wherever they stand; a text of these only needs no normalization.
_PLAIN = "^[\\x00-\\u02ff\\u3041-\\u3094\\u30a1-\\u30fa\\u30fc\\u4e00-\\u9fff\\u3000-\\u3002\\uff01-\\uff5e]*\\z"


def nfc(column: Column) -> Column:
    """Unicode NFC. Texts that are plainly in NFC, which is nearly all, are not normalized."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))

    return F.when(column.rlike(_PLAIN), column).otherwise(run(column))


def read(spark: SparkSession, path: str, kind: str = "parquet", text: str = "text", doc_id: str | None = "doc_id") -> DataFrame:
    """doc_id, text in NFC, and whether it is long. Kinds: parquet, json (lines), csv with a header, orc, and text, one document a file."""
    if kind == "text":
        raw = spark.read.text(path, wholetext=True).select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))
    else:
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"') if kind == "csv" else spark.read
        raw = reader.format(kind).load(path).select((F.col(doc_id) if doc_id else F.xxhash64(text)).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = raw.withColumn("text", nfc(F.col("text")))
    return out.withColumn("is_long", F.octet_length(F.encode("text", "UTF-16BE")) / 2 > LONG)


def write_masked(masked: DataFrame, path: str, kind: str = "parquet") -> DataFrame:
    """Writes doc_id and masked text; returns doc_id and a flag of the documents in which nothing was masked."""
    masked.select("doc_id", "masked").write.mode("errorifexists").format(kind).save(path)
    return masked.select("doc_id", (F.col("text") == F.col("masked")).alias("nothing_masked"))
