"""Precision, recall and F1 of spans against an annotated corpus."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keys(mode: str) -> list[str]:
    return ["doc_id", "category", "start", "end", "text"] if mode == "occurrence" else ["doc_id", "category", "text"]


def errors(expected: DataFrame, predicted: DataFrame, mode: str = "occurrence") -> tuple[DataFrame, DataFrame]:
    """(false negatives, false positives)."""
    keys = _keys(mode)
    a, b = expected.select(*keys).distinct(), predicted.select(*keys).distinct()
    return a.join(b, keys, "left_anti"), b.join(a, keys, "left_anti")


def score(expected: DataFrame, predicted: DataFrame, mode: str = "occurrence") -> DataFrame:
    """tp, fp, fn, precision, recall and f1 by category, and overall (category null). Equal keys count once; 0 where nothing is divided by."""
    keys = _keys(mode)
    sides = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("p")).unionByName(predicted.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("p")))
    return summarise(sides, keys)


def summarise(sides: DataFrame, keys: list[str]) -> DataFrame:
    """As ``score``, of rows that say with e and p (0 or 1) on which side they are; both sides may come from one scan."""
    each = sides.groupBy(*keys).agg(F.max("e").alias("e"), F.max("p").alias("p"))
    n = each.rollup("category").agg(F.sum(F.col("e") * F.col("p")).alias("tp"), F.sum((1 - F.col("e")) * F.col("p")).alias("fp"), F.sum(F.col("e") * (1 - F.col("p"))).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def evaluate(corpus: DataFrame, candidates: DataFrame, mode: str = "occurrence") -> DataFrame:
    """Scores of ``candidates`` (doc_id, category, text, start, end, of any category) against a corpus with entities."""
    expected = corpus.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*")
    known = ("PERSON", "ORGANIZATION", "ADDRESS")
    return score(expected, candidates.where(F.col("category").isin(*known)), mode)


def placed(texts: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs (doc_id, ord, category, text, start, end) with a place for those that have none, in the order of ``ord`` in their document.

    Each is looked for behind the one placed before it, then from the start of the text; what does not occur is left out.
    """
    row = F.struct("ord", "category", "text", "start", "end")
    each = outputs.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("rows")).join(texts.select("doc_id", F.col("text").alias("source")), "doc_id")
    first = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<category:string,text:string,start:int,end:int>>").alias("out"))

    def step(acc, o):
        given = o["start"].isNotNull() & o["end"].isNotNull() & (o["end"] > o["start"])
        behind, any_ = F.position(o["text"], F.col("source"), acc["at"]), F.position(o["text"], F.col("source"))
        found = F.when(behind > 0, behind).otherwise(any_)
        start = F.when(given, o["start"]).otherwise(found - 1)
        end = F.when(given, o["end"]).otherwise(start + F.length(o["text"]))
        keep = (given | (found > 0)) & (F.length(o["text"]) > 0) & (start >= 0) & (end <= F.length("source"))
        new = F.array_append(acc["out"], F.struct(o["category"].alias("category"), o["text"].alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct(F.when(given | (found == 0), acc["at"]).otherwise(end + 1).cast("int").alias("at"), F.when(keep, new).otherwise(acc["out"]).alias("out"))

    return each.select("doc_id", F.explode(F.aggregate("rows", first, step)["out"]).alias("x")).select("doc_id", "x.*")


def distinct_counts(entities: DataFrame) -> DataFrame:
    """Distinct targets (document, category, text) and occurrences (document, category, start, end), by category."""
    return entities.groupBy("category").agg(F.count_distinct("doc_id", "category", "text").alias("targets"), F.count_distinct("doc_id", "category", "start", "end").alias("occurrences"))


def median_times(timings: DataFrame) -> DataFrame:
    """The median of ``ms`` by ``operation``, the mean of the middle two of an even number."""
    return timings.groupBy("operation").agg(F.median("ms").alias("median_ms"), F.count("*").alias("runs"))


def corpus_digest(corpus: DataFrame) -> str:
    """A hash of all documents in any order: sums of parts of their hashes, so that no task sees more than a number of each."""
    h = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"p{i}") for i in range(8)]
    row = corpus.agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256(":".join(str(x) for x in row).encode()).hexdigest()


def write_result(scores: DataFrame, corpus: DataFrame, path: str, timings: DataFrame | None = None, **about) -> None:
    """One JSON document a category, with the hash of the corpus, median times by operation, and what else is to be told."""
    out = scores.withColumn("corpus_sha256", F.lit(corpus_digest(corpus)))
    if timings is not None:
        medians = {r["operation"]: r["median_ms"] for r in median_times(timings).collect()}  # one row an operation
        out = out.withColumn("median_ms", F.create_map(*[F.lit(x) for pair in sorted(medians.items()) for x in pair]))
    for k, v in about.items():
        out = out.withColumn(k, F.lit(v))
    out.coalesce(1).write.mode("errorifexists").json(path)
