"""Near-duplicate documents by MinHash, and their connected components.

1. Every document becomes its set of word shingles (64-bit hashes). Documents with the same set are one
   node, named by their smallest doc_id; only nodes go on.
2. A node's signature is its minimum (the lowest byte of it) under 240 universal hashes, in 40 bands of 6: a pair of similarity 0.8
   shares no band with probability 5e-6, one of 0.35 with 0.93. A bucket is a band value that several nodes have.
3. Each node is proposed with the hub of one of its buckets, the member whose buckets are the largest, so that a
   bucket of n nodes makes n pairs. Proposals are compared by signature, then confirmed on the full sets, and the
   confirmed links make components, which join most of any tight group.
4. What is left are links between components. In each bucket that still holds several, all pairs of different
   components are compared by signature, in tiles of about 2 * BLOCK nodes, and those alike enough are
   confirmed on full sets. The nodes of a bucket's largest component meet the others only, so a few strays in a large bucket
   cost its size and not its square. A pair is looked at in the first bucket that it shares. This runs twice: first each
   node keeps its best partner of a block, which joins most of what can be joined, then all pairs are kept. For
   the second time the nodes left get EXTRA more minima, so that few pairs below the threshold are confirmed in vain.
5. Components come from alternating large-star and small-star steps on the links.

Nothing is collected to the driver but counts. Joins on a bucket or a node read written tables on both sides, so
that adaptive execution can split a hot one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import emit, lean, mix, prefix_hash, Scratch, span_hash, steps, table, utf8, word_spans

HASHES, ROWS = 240, 6
EXTRA = 960
BLOCK = 512
#: Most links of one node that are confirmed in one place.
PLACE = 256
#: Standard errors of the signature's estimate that a pair may be below the threshold and still be confirmed on sets.
MARGIN = 4.2
SHINGLE, PERCENT = 5, 80

_A, _MORE = (np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed, n in ((5, HASHES), (6, EXTRA)))
_ODD = np.uint64(0x9E3779B185EBCA87)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one text after the other, and each text's end points."""
    raw = _LOWER[raw]
    s, e, doc = word_spans(raw, at)
    words = span_hash(prefix_hash(raw), s, e)
    first = np.searchsorted(doc, np.arange(len(at)))
    windows = words[: max(0, len(words) - k + 1)].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            windows = windows * _ODD + words[i : len(words) - k + 1 + i]
        windows = mix(windows)
        sets = []
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                sets.append(np.unique(windows[a : b - k + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for w in words[a:b]:
                    h = h * _ODD + w
                sets.append(mix(np.array([h], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), ends


def signatures(values: np.ndarray, ends: np.ndarray, hashes: np.ndarray = _A) -> np.ndarray:
    """The minima under each hash, a row for each set that isn't empty."""
    starts = ends[:-1][np.diff(ends) > 0]
    out = np.zeros((len(starts), len(hashes)), np.uint64)
    if len(starts):
        h = np.empty_like(values)
        with np.errstate(over="ignore"):
            for i, a in enumerate(hashes):
                np.multiply(values, a, out=h)
                out[:, i] = np.minimum.reduceat(h, starts)
    return out


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(1))
            for lo, hi in steps(at):
                values, ends = shingle_sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k)
                size = np.diff(ends)
                full = size > 0
                sig, bands, keys = np.empty(hi - lo, object), np.empty(hi - lo, object), np.zeros((2, hi - lo), np.int64)
                if full.any():
                    starts = ends[:-1][full]
                    minima = signatures(values, ends)
                    for i, low, key in zip(np.flatnonzero(full), (minima & np.uint64(255)).astype(np.uint8), band_keys(minima)):
                        sig[i], bands[i] = low.tobytes(), key
                    with np.errstate(over="ignore"):
                        keys[0, full] = np.add.reduceat(mix(values ^ _ODD), starts).view(np.int64)
                        keys[1, full] = np.bitwise_xor.reduceat(mix(values + _ODD), starts).view(np.int64)
                yield emit(_FEATURES, [batch.column(0).slice(lo, hi - lo), size, *(pa.array(x, pa.int64(), mask=~full) for x in keys), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))])

    return run


def _more(k: int):
    """Rows (id, text) -> id and the lowest bytes of the extra minima; texts without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("more", pa.binary())])
        for batch in batches:
            raw, at = utf8(batch.column(1))
            for lo, hi in steps(at):
                values, ends = shingle_sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k)
                low = (signatures(values, ends, _MORE) & np.uint64(255)).astype(np.uint8)
                yield emit(schema, [batch.column(0).slice(lo, hi - lo).filter(pa.array(np.diff(ends) > 0)), [x.tobytes() for x in low]])

    return run


def band_keys(minima: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, which also depends on the band."""
    parts = minima.reshape(len(minima), HASHES // ROWS, ROWS)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, HASHES // ROWS + 1, dtype=np.uint64) * _ODD, parts.shape[:2])
        for i in range(ROWS):
            h = mix(h ^ parts[:, :, i])
    return h.view(np.int64)


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x, y = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
                own = pa.array((x == y).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(own), part.column(1).filter(own)], schema=schema)

    return run


def _confirm(k: int, percent: int):
    """Rows (a, b, text), sorted by a with the row of a itself (b null) first: the pairs whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        hub, of = np.zeros(0, np.uint64), None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            raw, at = utf8(batch.column(2))
            found = []
            for lo, hi in steps(at):
                values, ends = shingle_sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k)
                for i in range(hi - lo):
                    own = values[ends[i] : ends[i + 1]]
                    if b[lo + i] is None:
                        hub, of = own.copy(), a[lo + i]
                    elif a[lo + i] == of:
                        both = len(np.intersect1d(hub, own, assume_unique=True))
                        if both and 100 * both >= percent * (len(hub) + len(own) - both):
                            found.append((of, b[lo + i]))
            yield emit(schema, list(zip(*found)) if found else [[], []])

    return run


def _least(percent: int, hashes: int = HASHES) -> float:
    """The share of equal signature bytes from which a pair may be near enough."""
    share = percent / 100
    least = share - MARGIN * (share * (1 - share) / hashes) ** 0.5
    return least + (1 - least) / 256  # the lowest bytes of different minima are equal that often


def _similar(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b): those whose signatures are as alike as the sets may be."""
    sig_a, sig_b = (nodes.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    joined = pairs.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sig_a", "sig_b")
    return joined.mapInArrow(lean(_alike(_least(percent))), "a long, b long")


def _across(percent: int, best: bool):
    """Rows (key, i, j, g, id, size, c, sig, bands), sorted by (key, i, j): pairs of different components.

    A group holds block i of a bucket and block j; g is a row's own. Pairs are of blocks i and j, or of i alone.
    The first bucket that a pair shares is that of the first band whose keys are equal; signatures do not tell it, as
    their bytes are also equal where minima are not.
    """
    least, least_all = _least(percent), _least(percent, HASHES + EXTRA)

    def solve(key: int, i: int, j: int, rows: list[tuple]) -> list[tuple[int, int]]:
        g, ids, size, c = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        whole = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        bands = np.stack([r[5] for r in rows])
        sig = whole[:, :HASHES]
        own = np.flatnonzero(g == i)
        out = []
        for x in own:
            others = np.flatnonzero((g == j) & (c != c[x]) & ((ids > ids[x]) | (i != j)) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])))
            if len(others):
                same = sig[others] == sig[x]
                near = same.mean(axis=1) >= least
                others, same = others[near], same[near]
                if whole.shape[1] > HASHES and len(others):
                    near = (whole[others] == whole[x]).mean(axis=1) >= least_all
                    others, same = others[near], same[near]
                if best and len(others):
                    top = same.sum(axis=1).argmax()
                    others = others[top : top + 1]
                first = (bands[others] == bands[x]).argmax(axis=1)
                out += [(int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))) for y in others[bands[x][first] == key]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        key, rows, found = None, [], []
        for batch in batches:
            keys = batch.column(8).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else []
            for k, i, j, *row in zip(*(c.to_pylist() for c in batch.columns[:8]), keys):
                if key != (k, i, j):
                    if len(rows) > 1:
                        found += solve(*key, rows)
                    key, rows = (k, i, j), []
                rows.append(row)
            if len(found) > 10_000:
                yield emit(schema, list(zip(*found)))
                found = []
        if len(rows) > 1:
            found += solve(*key, rows)
        yield emit(schema, list(zip(*found)) if found else [[], []])

    return run


def _linked(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), read from a written table, those confirmed on full sets.

    b's texts go to a's, in as many places as a has PLACEs of them. The join is by sorting at any size: the list
    of pairs has no bound that would let it be broadcast.
    """
    most = pairs.groupBy("a").count().agg(F.max("count")).first()[0] or 0
    pairs = pairs.withColumn("salt", F.pmod(F.hash("b"), F.lit(max(1, -(-most // PLACE)))))
    hubs = pairs.select(F.col("a").alias("id"), "a", "salt").distinct().withColumn("b", F.lit(None).cast("long"))
    wanted = hubs.unionByName(pairs.select(F.col("b").alias("id"), "a", "salt", "b"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    placed = wanted.join(texts.hint("merge"), "id").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return placed.select("a", "b", "text").mapInArrow(lean(_confirm(k, percent)), "a long, b long")


def components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that it reaches.

    Alternates large-star (a node's larger neighbours join its smallest) and small-star (its smaller ones and
    itself do) until nothing changes. Self links and repeated links do no harm.
    """

    def star(pairs: DataFrame, large: bool, name: str) -> DataFrame:
        seen = pairs.select("u", "v")
        if large:
            seen = seen.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
        joined = seen.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        out = scratch.save(out.where("u > v").distinct(), name)
        scratch.drop(f"{name}-least")
        return out

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}0")
    was, step = state(now), 0
    while was[0]:
        step += 1
        large = star(now, True, f"{label}{step}-large")
        now = star(large, False, f"{label}{step}")
        scratch.drop(f"{label}{step}-large", f"{label}{step - 1}")
        if (new := state(now)) == was:
            break
        was = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _open_pairs(shared: DataFrame, nodes: DataFrame, member: DataFrame, docs: DataFrame | None, k: int, scratch: Scratch, percent: int, label: str) -> DataFrame:
    """Distinct pairs (a, b) of different components that share a bucket and whose signatures are alike enough.

    Without ``docs``, the best partners only; with them, signatures are lengthened first.
    """
    placed = shared.join(member.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    placed = scratch.save(placed, f"placed{label}")
    mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    open_ = scratch.save(placed.join(scratch.save(mixed.select("key"), f"mixed{label}"), "key"), f"open{label}")
    sizes = open_.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    plan = scratch.save(sizes.select("key", F.col("top.c").alias("major"), blocks(F.col("n") - F.col("top.n")).alias("minors"), blocks(F.col("top.n")).alias("majors")), f"plan{label}")
    open_ = open_.join(plan, "key")
    signed = nodes.select("id", "size", "sig", "bands")
    if docs is not None:
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).hint("merge")
        more = scratch.save(open_.select("id").distinct().join(texts, "id").mapInArrow(lean(_more(k)), "id long, more binary"), f"extra{label}")
        signed = signed.join(more, "id").select("id", "size", F.concat("sig", "more").alias("sig"), "bands")
    # Blocks of the other components come first, those of the largest behind them; no tile has two of the latter.
    major = F.col("c") == F.col("major")
    g = F.when(major, F.col("minors") + F.pmod(F.hash("id"), F.col("majors"))).otherwise(F.pmod(F.hash("id"), F.col("minors")))
    h = F.explode(F.sequence(F.lit(0), F.when(major, F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1))
    block = open_.join(signed, "id").withColumn("g", g).withColumn("h", h)
    block = block.select("key", F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"), "g", "id", "size", "c", "sig", "bands")
    pairs = block.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean(_across(percent, docs is None)), "a long, b long")
    return pairs.distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    A text with fewer than k words is one shingle. A text without words (or null) has an empty set, is linked with
    nothing and is its own component. Rows of the same doc_id count as one document. Rows without a doc_id
    take part as copies only: theirs is the component of documents with the same set, or null, and then they are
    kept. Long texts are shingled whole; ties cannot matter, as a component is named by its smallest doc_id. Other columns
    are not looked at. No rows, no result.
    """
    scratch = Scratch(spark, "neardup")
    features = scratch.save(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_features(k)), "doc_id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"), "features")
    classes = features.where("k1 is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"))
    classes = scratch.save(classes, "classes")
    nodes = features.join(classes, ["k1", "k2"]).where(F.col("doc_id") == F.col("id")).select("id", F.col("n_shingles").alias("size"), "sig", "bands")
    nodes = scratch.save(nodes, "nodes")
    if nodes.count() > classes.count():  # rows repeated with their doc_id
        nodes = scratch.save(nodes.dropDuplicates(["id"]), "nodes1")
    bands = scratch.save(nodes.select(F.posexplode("bands").alias("band", "key"), "id"), "bands")
    buckets = scratch.save(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = scratch.save(bands.join(buckets, "key"), "shared")
    weight = scratch.save(shared.groupBy("id").agg(F.sum("n").alias("w")), "weight")
    weighed = scratch.save(shared.join(weight, "id").select("key", "id", "w"), "weighed")
    hubs = scratch.save(weighed.groupBy("key").agg(F.max(F.struct("w", -F.col("id"))).alias("top")).select("key", (-F.col("top.col2")).alias("a"), F.col("top.w").alias("w")), "hubs")
    scratch.drop("bands", "buckets", "weight")

    best = weighed.select("key", F.col("id").alias("b")).join(hubs, "key").where("a <> b").groupBy("b").agg(F.max(F.struct("w", -F.col("a"))).alias("top"))
    proposed = scratch.save(_similar(best.select("b", (-F.col("top.col2")).alias("a")), nodes, percent), "proposed")
    links = scratch.save(_linked(proposed, docs, k, percent), "links")
    member = scratch.save(components(links, scratch), "member")

    scratch.drop("weighed", "hubs", "proposed")

    for step, whole in enumerate((None, docs)):
        more = scratch.save(_open_pairs(shared, nodes, member, whole, k, scratch, percent, f"{step}"), f"more{step}")
        if not more.isEmpty():
            links = links.unionByName(scratch.save(_linked(more, docs, k, percent), f"more-links{step}"))
            member = scratch.save(components(links, scratch, f"again{step}"), f"member{step}")

    named = scratch.save(classes.select("k1", "k2", "id").join(member.withColumnRenamed("node", "id"), "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component_id")), "named")
    scratch.drop("nodes", "shared", "more0", "more1", "links", "more-links0", "more-links1")
    found = features.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), k=4)


def near_sql(k: int, percent: int = PERCENT) -> str:
    """CTEs ``sh`` to ``near`` (doc_id, n_shingles, component_id, kept) over a relation ``docs``."""
    return f"""
nw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM docs),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < {k} THEN ws ELSE ws[i:i + {k - 1}] END AS s FROM nw, LATERAL (SELECT unnest(range(1, greatest(len(ws) - {k - 1}, 1) + 1)) AS i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
          HAVING 100 * count(*) >= {percent} * ((SELECT n FROM sizes WHERE doc_id = a.doc_id) + (SELECT n FROM sizes WHERE doc_id = b.doc_id) - count(*))),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM docs UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a),
near AS (SELECT d.doc_id, CAST(coalesce(any_value(z.n), 0) AS BIGINT) AS n_shingles, min(r.r) AS component_id, d.doc_id = min(r.r) AS kept
         FROM docs d JOIN reach r USING (doc_id) LEFT JOIN sizes z USING (doc_id) GROUP BY d.doc_id)
"""


SQL = f"WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents), {near_sql(4)} SELECT * FROM near"
