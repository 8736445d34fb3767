"""Annotated corpora: JSON documents whose text marks entities as ``[[CATEGORY|text]]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import blank

CATEGORIES = ("PERSON", "ORGANIZATION", "ADDRESS")
_MARK = r"\[\[([A-Z_]+)\|([^\]]*)\]\]"


def parse(annotated: Column) -> Column:
    """struct<text, entities: array<struct<category, start, end, text>>> by built-in expressions; bad marks raise."""
    kinds, values = F.regexp_extract_all(annotated, F.lit(_MARK), F.lit(1)), F.regexp_extract_all(annotated, F.lit(_MARK), F.lit(2))
    plain = F.split(annotated, _MARK, -1)
    empty = F.array().cast("array<struct<category:string,start:int,end:int,text:string>>")
    start = F.struct(F.length(F.element_at(plain, 1)).alias("at"), empty.alias("out"))

    def step(acc: Column, i: Column) -> Column:
        value, end = F.element_at(values, i), acc["at"] + F.length(F.element_at(values, i))
        return F.struct((end + F.length(F.element_at(plain, i + 1))).alias("at"), F.array_append(acc["out"], F.struct(F.element_at(kinds, i).alias("category"), acc["at"].alias("start"), end.alias("end"), value.alias("text"))).alias("out"))

    found = F.aggregate(F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values))).otherwise(F.array().cast("array<int>")), start, step)["out"]
    text = F.regexp_replace(annotated, _MARK, "$2")
    wrong = F.exists(kinds, lambda k: ~k.isin(*CATEGORIES)) | F.exists(values, lambda v: blank(v)) | text.contains("[[") | text.contains("]]")
    return F.when(wrong, F.raise_error(F.concat(F.lit("bad annotation: "), annotated)).cast("struct<text:string,entities:array<struct<category:string,start:int,end:int,text:string>>>")).otherwise(F.struct(text.alias("text"), found.alias("entities")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text and entities of a corpus file; ids that occur twice raise."""
    raw = spark.read.option("multiLine", True).schema("version int, description string, documents array<struct<id:string,annotatedText:string>>").json(path)
    docs = raw.select(F.explode("documents").alias("d")).select(F.col("d.id").alias("doc_id"), parse(F.col("d.annotatedText")).alias("p")).select("doc_id", "p.text", "p.entities")
    twice = docs.groupBy("doc_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"document id occurs twice: {twice[0]['doc_id']}")
    return docs
