"""Nearest neighbours by largest inner product through an inverted multi-index.

Vectors are cut into halves, each half quantised by its own k-means codebook; a cell is a pair of centroids.
A query walks the pairs in the order of summed distance (the negated inner product with the centroid, per
half), in strips of eight second centroids, until the cells hold a share of the vectors, and all
of these are reranked exactly. The distance at which the walk ends says which cells a query visits.

The codebooks are fitted on a bounded sample; every vector is indexed. The share is learned too: on a part of the sample that the
codebooks have not seen, it is what has to be visited for ``RECALL`` of the nearest. Clustered vectors need little of
the index, vectors without any direction in common a quarter of it or more.

Sizes known to the driver are the codebooks and one count a cell, at most ``MAX_CENTROIDS ** 2``. Vectors are scored in tiles: a
block of vectors, which are stored by cell, against the queries that visit one of its cells, ``BLOCK_Q`` of all queries at a time. So
a vector is sent once for ``BLOCK_Q`` queries, a query once for each block that it visits. Of equal vectors only the
TOP + 1 with the smallest ids can be among anyone's nearest, so no others are scored, and equal queries are answered once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, Scratch, table

TOP = 20
SAMPLE = 20_000
MAX_CENTROIDS = 1024
#: The recall that the share of vectors to rerank is learned for, on how many queries, and how many are reranked at least.
RECALL, TRIED, PROBE = 0.93, 400, 1_000
STRIP = 8
#: Vectors and queries of a tile: as many blocks as tasks can share where there are few vectors, of bounded size where there are many.
BLOCKS, LEAST_V, BLOCK_V, BLOCK_Q = 16, 1024, 16_384, 16_384


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k centroids (fewer if there are fewer rows) by Lloyd's algorithm, float64."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.integers(0, len(x), int((n == 0).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ c.T - half, axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


def walk(d1: np.ndarray, d2: np.ndarray, columns: np.ndarray, probe: int) -> float:
    """The summed distance up to which cells are visited so that they hold ``probe`` vectors (all: infinity).

    ``columns`` has the counts: a row for each second centroid and a column for each first one. Strips are visited in the
    order of their distance, so where a walk ends is a weighted quantile: it is looked for in the one of 4096 steps of
    distance in which it lies.
    """
    o2 = np.argsort(d2, kind="stable")
    strips = np.add.reduceat(columns[o2], np.arange(0, len(d2), STRIP), axis=0, dtype=np.int64).ravel()
    keys = (d2[o2[::STRIP], None] + d1).ravel()
    if strips.sum() < probe:
        return float("inf")
    least, most = keys.min(), keys.max()
    if most <= least:
        return float(least)
    step = ((keys - least) * (4095 / (most - least))).astype(np.int64)
    held = np.cumsum(np.bincount(step, strips))
    last = int(np.searchsorted(held, probe))
    at = np.flatnonzero(step == last)
    at = at[np.argsort(keys[at], kind="stable")]
    before = held[last - 1] if last else 0
    return float(keys[at[np.searchsorted(np.cumsum(strips[at]) + before, probe)]])


def strip_start(d2: np.ndarray) -> np.ndarray:
    """For each query (row), by second centroid: the distance at which its strip begins."""
    order = np.argsort(d2, axis=1)
    ordered = np.take_along_axis(d2, order, axis=1)
    if (ordered[:, 1:] == ordered[:, :-1]).any():
        order = np.argsort(d2, axis=1, kind="stable")
    out = np.empty_like(d2)
    np.put_along_axis(out, order, np.repeat(ordered[:, ::STRIP], STRIP, axis=1)[:, : d2.shape[1]], axis=1)
    return out


def blocks(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each row of the index: small rows share one, large ones are split."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    block = held = 0
    for i, n in enumerate(counts.sum(axis=1)):
        if held and held + n > size:
            block, held = block + 1, 0
        first[i], parts[i] = block, max(1, -(-int(n) // size))
        block += parts[i] - 1
        held = n if parts[i] == 1 and not held else held + n if parts[i] == 1 else size
    return first, parts


def needed_share(x: np.ndarray, c1: np.ndarray, c2: np.ndarray, cut: int, top: int, n: int) -> float:
    """The share of the index, in the order of a walk, that holds ``RECALL`` of the nearest. ``x`` are vectors that are
    not in the codebooks; as many of them are looked for as are among the ``top`` of n. Of a few vectors, all are needed."""
    if len(x) < 4 * top:
        return 1.0
    q = x[:TRIED]
    own = np.arange(len(q))
    real, seen = q @ x.T, (q[:, :cut] @ c1.T)[:, nearest(x[:, :cut], c1)] + (q[:, cut:] @ c2.T)[:, nearest(x[:, cut:], c2)]
    real[own, own] = -np.inf
    k = min(top, max(1, round(top * len(x) / n)))
    found = np.take_along_axis(seen, np.argpartition(-real, k - 1, axis=1)[:, :k], axis=1)
    before = np.stack([(row[:, None] > f).sum(axis=0) for row, f in zip(seen, found)])
    return float(min(1.0, np.quantile((before + 1) / len(x), RECALL, method="higher")))


def _matrix(column: pa.Array, dim: int, kind: str = "<f4") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _pack_vectors(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(v, kind).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["vec_id", "vec"])

    return run


def valid(vectors: DataFrame) -> tuple[DataFrame, str]:
    """vec_id and vec (bytes) of the rows that take part, and their numpy type: doubles stay doubles."""
    wide = vectors.schema["embedding"].dataType.elementType.typeName() != "float"
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>" if wide else "array<float>"))
    rows = rows.where(F.col("vec_id").isNotNull() & whole & F.exists("embedding", lambda x: x != 0))
    kind = "<f8" if wide else "<f4"
    return rows.mapInArrow(lean(_pack_vectors(kind)), "vec_id long, vec binary"), kind


def search(spark: SparkSession, vectors: DataFrame, query_every: int = 20, top: int = TOP, share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``query_every`` its ``top`` nearest other vectors.

    Rows with a null vec_id or vector, with zero vectors, null or non-finite components, or of another length than
    most vectors (of the longer, at a tie) take no part. Ties in score go to the smaller vec_id. Rows that share a vec_id
    are one vector, that whose bytes are the smallest; it never finds itself. ``share`` is the share of all vectors
    that a query reranks, learned if it isn't given. Other columns are not looked at. No vectors, no rows.
    """
    scratch = Scratch(spark, "ann")
    rows, kind = valid(vectors)
    rows = scratch.save(rows, "rows")
    lengths = rows.groupBy(F.length("vec").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = np.dtype(kind).itemsize
    dim = lengths["bytes"] // width
    rows = rows.where(F.length("vec") == width * dim)
    ids, every = rows.agg(F.count_distinct("vec_id"), F.count("*")).first()
    if ids < every:
        rows = scratch.save(rows.groupBy("vec_id").agg(F.min("vec").alias("vec")), "rows1")
    equal = Window.partitionBy("vec").orderBy("vec_id")
    first_ones = scratch.save(rows.withColumn("k", F.row_number().over(equal)).where(F.col("k") <= top + 1).select("vec_id", "vec"), "first_ones")
    n = first_ones.count()
    sample = _matrix(pa.array([bytes(r["vec"]) for r in first_ones.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").collect()], pa.binary()), dim, kind).astype(np.float64)
    k, cut = int(min(MAX_CENTROIDS, max(1, round(1.2 * n**0.5)))), max(1, dim // 2)
    fitted = len(sample) - len(sample) // 4
    c1, c2 = codebook(sample[:fitted, :cut], k), codebook(sample[:fitted, cut:], k if dim > cut else 1)
    share = needed_share(sample[fitted:], c1, c2, cut, top, n) if share is None else share
    probe = max(PROBE, int(np.ceil(share * n)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim, kind).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(nearest(x[:, :cut], c1), pa.int32()), pa.array(nearest(x[:, cut:], c2), pa.int32()), *batch.columns], names=["i", "j", "vec_id", "vec"])

    index = scratch.save(first_ones.mapInArrow(lean(assign), "i int, j int, vec_id long, vec binary"), "index")
    counts = np.zeros((len(c1), len(c2)), np.int64)
    cells = index.groupBy("i", "j").count().toArrow()  # at most one row a cell
    counts[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["count"].to_numpy()
    columns = np.ascontiguousarray(counts.T, np.int32 if counts.sum() < 2**31 else np.int64)
    first, parts = blocks(counts, min(BLOCK_V, max(LEAST_V, n // BLOCKS)))
    n_blocks = int((first + parts).max())

    asked = scratch.save(rows.where(F.pmod("vec_id", F.lit(query_every)) == 0), "asked")
    queries = scratch.save(asked.groupBy("vec").agg(F.min("vec_id").alias("q")), "queries")
    n_queries = queries.count()
    blocks_q = -(-n_queries // BLOCK_Q)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to its block, once for each block of queries."""
        for batch in batches:
            i, ids = (batch.column(x).to_numpy(zero_copy_only=False) for x in (0, 2))
            block = first[i] + (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % parts[i]
            at = np.repeat(np.arange(len(i)), blocks_q)
            turn = np.tile(np.arange(blocks_q), len(i))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(block[at], pa.int32()), pa.array(turn, pa.int32()), pa.array(np.zeros(len(at)), pa.int8()), *(batch.column(x).take(take) for x in range(4)), pa.nulls(len(at), pa.float64())], names=_PLACED)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query, with the distance at which its walk ends, to the blocks it visits."""
        for batch in batches:
            x = _matrix(batch.column(1), dim, kind).astype(np.float64)
            d1, d2 = -x[:, :cut] @ c1.T, -x[:, cut:] @ c2.T
            q = batch.column(0).to_numpy(zero_copy_only=False)
            turn = (q.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % max(1, blocks_q)
            ends = np.array([walk(a, b, columns, probe) for a, b in zip(d1, d2)])
            seen = [(x_, b) for x_ in range(len(q)) for b in _visited(d1[x_] + d2[x_].min() <= ends[x_], first, parts, n_blocks)]
            at = np.array([s[0] for s in seen], np.int64)
            block = np.array([s[1] for s in seen], np.int32)
            take, none = pa.array(at), pa.nulls(len(at), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(turn[at], pa.int32()), pa.array(np.ones(len(at)), pa.int8()), none, none, batch.column(0).take(take), batch.column(1).take(take), pa.array(ends[at], pa.float64())], names=_PLACED)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by block with its vectors first: each query against those vectors whose cells it visits."""
        held, kept = None, []
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            edges = np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1
            out = [([], [], [])]
            for lo, hi in zip([0, *edges], [*edges, len(key)]):
                if lo == hi:
                    continue
                block, part = tuple(key[lo, :2]), batch.slice(lo, hi - lo)
                vec, ids = _matrix(part.column(6), dim, kind).astype(np.float64), part.column(5).to_numpy(zero_copy_only=False)
                if key[lo, 2] == 0:
                    if held != block:
                        held, kept = block, []
                    kept.append((vec, ids, *(part.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))))
                elif held == block:
                    if len(kept) > 1:
                        kept = [tuple(np.concatenate(x) for x in zip(*kept))]
                    ends = part.column(7).to_numpy(zero_copy_only=False)
                    out += [_best(vec[a : a + 64], ids[a : a + 64], ends[a : a + 64], *kept[0]) for a in range(0, len(vec), 64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.asarray(o[c], t.to_pandas_dtype()) for o in out]), t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["q", "vec_id", "score"])

    def _best(x: np.ndarray, q: np.ndarray, ends: np.ndarray, v: np.ndarray, ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple:
        rough = x @ v.T
        rough[np.take(-x[:, :cut] @ c1.T, i, axis=1) + np.take(strip_start(-x[:, cut:] @ c2.T), j, axis=1) > ends[:, None]] = -np.inf
        # The best of many groups of vectors: of these the (top + 1)-th is no larger than that of all vectors.
        groups = 4 * (top + 1)
        width = len(v) // groups
        if width > 1:
            most = rough[:, : groups * width].reshape(len(x), groups, width).max(axis=2)
            least = np.partition(most, groups - top - 1, axis=1)[:, groups - top - 1]
            least = np.where(np.isfinite(least), least - 1e-9 * np.maximum(1.0, np.abs(least)), -np.finfo(float).max)  # whatever the order of summation
        else:
            least = np.full(len(x), -np.finfo(float).max)
        r, at = np.nonzero(rough >= least[:, None])
        s = np.concatenate([(v[at[a : a + 8192]] * x[r[a : a + 8192]]).sum(axis=1) for a in range(0, len(r), 8192)]) if len(r) else np.zeros(0)
        best = np.lexsort((ids[at], -s, r))
        best = best[np.arange(len(r)) - np.searchsorted(r, r) <= top]  # r is in order already
        return q[r[best]], ids[at[best]], s[best]

    schema = "block int, turn int, kind byte, i int, j int, id long, vec binary, ends double"
    both = index.mapInArrow(lean(place), schema).unionByName(queries.select("q", "vec").repartition(min(1024, max(1, -(-n_queries // 256)))).mapInArrow(lean(route), schema))
    found = both.repartition(min(2048, 2 * n_blocks * max(1, blocks_q)), "block", "turn").sortWithinPartitions("block", "turn", "kind").mapInArrow(lean(score), "q long, vec_id long, score double")
    nearest_first = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = scratch.save(found.withColumn("k", F.row_number().over(nearest_first)).where(F.col("k") <= top + 1), "best")
    ids = scratch.save(asked.select(F.col("vec_id").alias("query_id"), "vec").join(queries, "vec").select("query_id", "q"), "ids")
    scratch.drop("rows", "first_ones", "index")
    pairs = ids.join(best, "q").select("query_id", "k", "vec_id", "score")
    # k is the place among all; behind the query's own row it is one less.
    own = pairs.where(F.col("vec_id") == F.col("query_id")).groupBy("query_id").agg(F.min("k").alias("self"))
    ranked = pairs.where(F.col("vec_id") != F.col("query_id")).join(own, "query_id", "left").withColumn("rank", F.col("k") - F.when(F.col("k") > F.col("self"), 1).otherwise(0))
    return ranked.where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


_PLACED = ["block", "turn", "kind", "i", "j", "id", "vec", "ends"]


def _visited(rows: np.ndarray, first: np.ndarray, parts: np.ndarray, n_blocks: int) -> np.ndarray:
    """Blocks of the rows of the index that are set."""
    edge = np.zeros(n_blocks + 1, np.int64)
    np.add.at(edge, first[rows], 1)
    np.add.at(edge, (first + parts)[rows], -1)
    return np.flatnonzero(np.cumsum(edge[:-1]))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings"))
