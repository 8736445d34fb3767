"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's rate is the mean number of times its documents should appear, so that the sources'
shares of the output's characters come near their weights. Each document draws its count from the
Poisson distribution of that rate by inversion at a hash of the seed and its id, is exploded by the
count, and all copies are dealt and sorted by another hash. Nothing is random at run time: a task
that is run again makes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SEED = 17
#: Target shares of the production mix: the one large source gets a quarter, each other one 4 %.
WEIGHTS = {"src0": 0.24} | {f"src{i}": 0.04 for i in range(1, 20)}
_BITS = 48
#: Largest mean that is inverted at once; a larger rate is drawn as the sum of so many draws of equal, smaller means.
MEAN = 64


def _hash48(*parts: Column | str) -> Column:
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long")


def _name() -> Column:
    """What a row's hashes are made of: its doc_id, or its text where it has none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))


def rates(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row for each listed source that has documents: source, rate, draws, cdf. At most ``len(weights)`` rows.

    The weights of the sources present are scaled to 1 and the volume stays: the rates are
    weight * (characters of all listed sources) / (characters of the source). A source whose texts are all
    empty, like a source that is not listed (or null), keeps the rate 1 and every document once. ``cdf`` is the
    distribution of one of ``draws`` draws, each of a mean of ``MEAN`` at most, so it is a short list at any rate.
    """
    size = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size")).where(F.col("source").isin(*weights))
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    sized = size.where("size > 0").withColumn("weight", F.element_at(weight, F.col("source")).cast("double"))
    # Over at most len(weights) rows, in a fixed order, so that sums are the same each time.
    every = Window.partitionBy(F.lit(0)).orderBy("source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = sized.withColumn("total", F.sum("size").over(every)).withColumn("weights", F.sum("weight").over(every))
    rate = totals.select("source", (F.col("weight") / F.col("weights") * F.col("total") / F.col("size")).alias("rate"))
    rate = rate.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN)).cast("long")).withColumn("mean", F.col("rate") / F.col("draws"))
    last = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 40).cast("int")
    start = F.struct((-F.col("mean")).alias("log_p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))

    def more(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.ln(F.col("mean") / k)
        return F.struct(log_p.alias("log_p"), F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + F.exp(log_p)).alias("cdf"))

    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1), last), start, more)["cdf"]).otherwise(F.array(F.lit(1.0)))
    return rate.select("source", "rate", "draws", cdf.alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float], seed: int = SEED) -> DataFrame:
    """``docs`` with each row as often as it was drawn, and copy (from 1), rate and shuffle_key, globally shuffled.

    Rows of the same doc_id draw the same count, and so do rows without one that have the same text. Null sources keep
    their rows once; null texts count as empty but are drawn as others, and so are long ones. Copies with equal
    shuffle keys come in any order. Needs doc_id, text and source; other columns are carried along whatever their
    names, but for any named copy, rate or shuffle_key, which are replaced. An empty table stays empty.
    """
    docs = docs.drop("copy", "rate", "shuffle_key")
    own = {}
    for name in ("source", "rate", "draws", "cdf", "n"):  # names that no column of docs has
        own[name] = f"_{name}"
        while own[name].lower() in (c.lower() for c in docs.columns):
            own[name] = "_" + own[name]
    listed = rates(docs, weights).select(*[F.col(c).alias(own[c]) for c in ("source", "rate", "draws", "cdf")])

    def draw(*part: Column) -> Column:
        u = _hash48("count", str(seed), _name(), *part) / F.lit(float(1 << _BITS))
        return F.size(F.filter(own["cdf"], lambda p: p <= u)).cast("long")

    many = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col(own["draws"])), F.lit(0).cast("long"), lambda total, i: total + draw(i))
    drawn = F.when(F.col(own["cdf"]).isNull(), F.lit(1).cast("long")).when(F.col(own["draws"]) == 1, draw()).otherwise(many)
    joined = docs.join(F.broadcast(listed), docs["source"] == F.col(own["source"]), "left")
    counted = joined.withColumn(own["n"], drawn.cast("int")).where(F.col(own["n"]) > 0)
    copies = counted.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(own["n"]))).alias("copy"), F.round(F.coalesce(own["rate"], F.lit(1.0)), 9).alias("rate"))
    keyed = copies.withColumn("shuffle_key", _hash48("order", str(seed), _name(), F.col("copy")))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), WEIGHTS)


_VALUES = ", ".join(f"('{s}', {w}::DOUBLE)" for s, w in WEIGHTS.items())
_SQL_HASH = "CAST(concat('0x', substr(md5({}), 1, 12)) AS BIGINT)"

_SQL_NAME = "coalesce(CAST(doc_id AS VARCHAR), concat('text:', md5(coalesce(text, ''))))"

#: Rows of ``mix`` over a relation ``docs``; the columns of documents, copy, rate and name.
MIX_SQL = f"""
weights(source, weight) AS (VALUES {_VALUES}),
sized AS (SELECT d.source, CAST(sum(coalesce(length(d.text), 0)) AS BIGINT) AS size, any_value(w.weight) AS weight
          FROM docs d JOIN weights w ON d.source = w.source GROUP BY d.source HAVING sum(coalesce(length(d.text), 0)) > 0),
rated AS (SELECT source, weight / (SELECT sum(weight) FROM sized) * (SELECT CAST(sum(size) AS BIGINT) FROM sized) / size AS rate FROM sized),
shared AS (SELECT source, rate, greatest(1, CAST(ceil(rate / {MEAN}) AS BIGINT)) AS draws, rate / greatest(1, ceil(rate / {MEAN})) AS mean FROM rated),
terms AS (SELECT source, rate, k, -mean + coalesce(sum(CASE WHEN k > 0 THEN ln(mean / k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k), 0) AS log_p
          FROM shared, LATERAL (SELECT unnest(range(0, CAST(ceil(mean + 12 * sqrt(mean) + 40) AS BIGINT) + 1)) AS k)),
cdfs AS (SELECT source, rate, k, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY k) AS p FROM terms),
named AS (SELECT DISTINCT {_SQL_NAME} AS name, d.source, s.draws FROM docs d JOIN shared s ON d.source = s.source),
draws AS (SELECT name, source, {_SQL_HASH.format(f"concat('count:{SEED}:', name, CASE WHEN draws > 1 THEN concat(':', i) ELSE '' END)")} / {float(1 << _BITS)} AS u
          FROM named, LATERAL (SELECT unnest(range(1, draws + 1)) AS i)),
counts AS (SELECT d.name, d.source, any_value(c.rate) AS rate, count(*) FILTER (WHERE c.p <= d.u) AS n
           FROM draws d JOIN cdfs c ON d.source = c.source GROUP BY d.name, d.source),
mixed AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(r.copy AS INTEGER) AS copy, round(coalesce(c.rate, 1.0), 9) AS rate, d.name
          FROM (SELECT *, {_SQL_NAME} AS name FROM docs) d LEFT JOIN counts c ON d.name = c.name AND d.source = c.source,
          LATERAL (SELECT unnest(range(1, coalesce(c.n, 1) + 1)) AS copy) r)
"""
SQL = f"""
WITH docs AS (SELECT doc_id, text, lang, source, n_chars FROM documents), {MIX_SQL}
SELECT * EXCLUDE (name), {_SQL_HASH.format(f"concat('order:{SEED}:', name, ':', copy)")} AS shuffle_key FROM mixed
"""
