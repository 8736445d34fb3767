"""Quality by Bradley-Terry pairwise ranking.

A document's worth is a linear function of features of its text. It is learned from preference pairs (a
document labelled good over one labelled bad) by logistic loss on the difference of their features, with Newton
steps. The documents are then cut at a quantile of worth, the share of bad labels: the score is a logistic function
of worth that is 0.3 at that quantile.

The labelled rows learned from are a sample of at most ``SAMPLE``; all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repetition
from .common import emit, lean, prefix_hash, span_hash, steps, table, utf8, word_spans

#: Most labelled documents that are learned from: those with the smallest hashes of doc_id.
SAMPLE = 20_000
PAIRS = 200_000
FOLDS = 5
CUT = 0.3

_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"()?-", b"!", b"#*$%&|<>", b"\n", bytes(range(128, 256))]
_KIND = np.full(256, len(_KINDS), np.int64)
for _i, _k in enumerate(_KINDS):
    _KIND[list(_k)] = _i
N_FEATURES = len(_KINDS) + 9


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES for each text, all between 0 and about 1; a text without words has zeros."""
    n = len(at) - 1
    m = repetition.measure(raw, at)
    s, e, doc = word_spans(raw, at)
    of = np.repeat(np.arange(n), np.diff(at))
    kinds = np.bincount(of * (len(_KINDS) + 1) + _KIND[raw], minlength=n * (len(_KINDS) + 1)).reshape(n, -1)[:, : len(_KINDS)]
    size = np.maximum(np.diff(at), 1)
    words, chars = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1)
    earlier = repetition._copies(doc, span_hash(prefix_hash(raw), s, e))[0]
    columns = [
        *(kinds / size[:, None]).T,
        np.log1p(m["n_words"]) / 10,
        m["word_chars"] / words / 10,
        m["n_symbols"] / words,
        m["n_repeat_words"] / words,
        *(m[f"dup_{k}gram_chars"] / chars for k in repetition.NGRAM_LIMITS),
        m["dup_line_chars"] / chars,
        np.bincount(doc[~earlier], minlength=n) / words,
    ]
    out = np.stack(columns, axis=1)
    out[m["n_words"] == 0] = 0
    return np.minimum(out, 3.0)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 11) -> dict:
    """Weights of worth, and the slope and cut that make a score of it. With one label only, all score 0.5."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {"w": np.zeros(x.shape[1]), "mean": np.zeros(x.shape[1]), "std": np.ones(x.shape[1]), "slope": 0.0, "cut": 0.0, "level": 0.0}
    mean, std = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / std
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + 1e-3 * np.eye(len(w)), d.T @ (1 - p) / pairs - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    worth = np.sort(z @ w)
    k = len(bad)  # the cut lies between the documents on both sides of the quantile
    cut = (worth[k - 1] + worth[k]) / 2
    return {"w": w, "mean": mean, "std": std, "slope": 1.0, "cut": cut, "level": float(np.log(CUT / (1 - CUT)))}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    worth = (x - model["mean"]) / model["std"] @ model["w"]
    return 1 / (1 + np.exp(-np.clip(model["slope"] * (worth - model["cut"]) + model["level"], -700, 700)))


_X = pa.schema([("doc_id", pa.int64()), ("x", pa.binary())])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = utf8(batch.column(1))
        for lo, hi in steps(at):
            rows = features(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            yield emit(_X, [batch.column(0).slice(lo, hi - lo), [r.tobytes() for r in rows]])


def fold(doc_id: Column | str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(folds))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> dict:
    """The model of ``labels.quality`` learned from the labelled rows outside fold 0.

    Null or other labels are left out; of several for one doc_id the largest counts. A doc_id that several documents
    have is learned from once, by the text whose hash is smallest. Without documents, labels or one of both labels, all
    documents score 0.5.
    """
    labels = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    chosen = labels.where(fold("doc_id", folds) != 0).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one row a doc_id, so at most ``sample``
    rows = texts.mapInArrow(lean(_features), "doc_id long, x binary").join(F.broadcast(chosen), "doc_id").select("doc_id", "x", "y").collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float64).reshape(-1, N_FEATURES)
    return fit(x, np.array([r["y"] for r in rows], np.int64))


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: dict, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    A text without words, or null, has features of 0 and the score that these give; a long one is measured whole.
    held_out is null with doc_id. Ties and repeated rows score alike; other columns are not looked at. No rows, no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(2))
            for lo, hi in steps(at):
                s = predict(model, features(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]))
                yield emit(_SCORED, [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), s, (s >= CUT).astype(np.int32)])

    rows = docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id").cast("long").cast("string"), folds) == 0).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
