"""Removal of every byte inside a string of 200 bytes that also starts anywhere else.

1. A 200-byte window is routed by its minimizer, the smallest hash among its 32-byte substrings: equal
   windows have equal minimizers. Consecutive windows of one minimizer are a run, kept as a hash of its bytes.
2. A minimizer with one run, in which it occurs once, has no repeat. Where several runs are all that a minimizer
   has, and have the same bytes, all of their windows repeat. For the others ("open"), one copy of each distinct run goes to the shard of its minimizer.
3. A shard builds the suffix array of its runs by Larsson-Sadakane refinement and Kasai's common prefixes, and
   windows with a neighbour of 200 common bytes repeat. Minimizers whose runs exceed a shard are dealt to
   several; these also emit the sorted fingerprints of their distinct windows, and each list is looked
   up in the others by binary search.
4. The repeats come back to the runs that have the bytes, and from these to the documents.

Every step is a join or grouping on a hash; a run in thousands of copies is one row after step 2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import emit, lean, mix, powers, prefix_hash, Scratch, span_hash, steps, table, utf8

LENGTH = 200
GRAM = 32
#: Bytes of runs that one suffix array covers, and beyond which one minimizer's runs are dealt to several shards.
SHARD, SPLIT = 1 << 20, 1 << 16
#: Shards whose lists of fingerprints (32 bytes a window) are looked up in one place.
MERGED = 16

_RUNS = pa.schema([("m", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("c", pa.int64()), ("twice", pa.int32())])
_RUNS_DDL = "m long, id long, th long, start int, n int, c long, twice int"
_NO_ID = -(1 << 63)


# Suffix arrays --------------------------------------------------------------------------


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: groups that are equal so far are split by the rank of what follows, at doubled distance."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = int(symbols.max() + 1).bit_length()
    ahead = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([symbols + 1, np.zeros(ahead, np.int64)])
    for i in range(ahead):
        key = (key << bits) | padded[i : i + n]
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = ahead
    alone = new & np.append(new[1:], True)
    places = np.flatnonzero(~alone)
    while len(places):
        own = sa[places]
        second = rank[np.minimum(own + h, n)]
        order = np.argsort(rank[own] * (n + 2) + second + 1, kind="stable")
        own, second = own[order], second[order]
        first = rank[own]
        sa[places] = own
        new = np.ones(len(own), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[own] = places[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        alone = new & np.append(new[1:], True)
        places = places[~alone]
        h *= 2
    return sa


def common_prefixes(symbols: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[k]: common length of the suffixes sa[k - 1] and sa[k].

    Kasai's rule, that the value falls by one at most from a position to the next, fills all positions whose left
    neighbours agree; the others are compared, many at a time.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    derived = (before > 0) & (at > 0)
    derived[derived] = symbols[at[derived] - 1] == symbols[before[derived] - 1]
    todo = np.flatnonzero(~derived & (before >= 0))
    value = np.zeros(n, np.int64)
    padded = np.concatenate([symbols, [-1]])
    i, j, depth = todo, before[todo], 0
    while len(todo):
        same = (padded[np.minimum(i + depth, n)] == padded[np.minimum(j + depth, n)]) & (np.maximum(i, j) + depth < n)
        value[todo[~same]] = depth
        todo, i, j = todo[same], i[same], j[same]
        depth += 1
    reach = np.where(derived | (before < 0), 0, value + at)
    plcp = np.maximum(np.maximum.accumulate(reach) - at, 0)
    plcp[before < 0] = 0
    return plcp[sa]


def repeated_windows(runs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of all runs, by run and start: run, start, whether it repeats, whether it is its class's first."""
    sizes = np.array([len(r) for r in runs], np.int64)
    symbols = np.empty(int(sizes.sum()) + len(runs), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(runs), np.uint8)
    symbols[ends] = 256 + np.arange(len(runs))  # different ones, so that no common prefix goes on beyond a run
    sa = suffix_array(symbols)
    lcp = common_prefixes(symbols, sa)
    join = lcp >= length
    repeat = join | np.append(join[1:], False)
    hit, lead = np.zeros(len(symbols), bool), np.zeros(len(symbols), bool)
    hit[sa], lead[sa] = repeat, ~join
    starts = ends - sizes
    windows = np.maximum(sizes - length + 1, 0)
    run = np.repeat(np.arange(len(runs)), windows)
    start = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    return run, start, hit[starts[run] + start], lead[starts[run] + start]


# Runs -----------------------------------------------------------------------------------


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i where it fits."""
    span, m = 1, x
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - span : width - span + len(x) - width + 1])


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            raw, at = utf8(batch.column(1))
            for lo, hi in steps(at):
                part, ends = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                if len(part) < length:
                    continue
                prefix = prefix_hash(part)
                n = len(part) - gram + 1
                with np.errstate(over="ignore"):
                    grams = mix((prefix[gram:] - prefix[:-gram]) * powers(len(prefix))[1][:n])
                low = sliding_min(grams, length - gram + 1)
                doc = np.repeat(np.arange(hi - lo), np.diff(ends))[: len(low)]
                whole = np.arange(len(low)) + length <= ends[1:][doc]
                first = whole.copy()
                first[1:] &= ~whole[:-1] | (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                last = whole.copy()
                last[:-1] &= ~whole[1:] | first[1:]
                s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
                own = doc[s]
                left = np.concatenate([[0], np.cumsum(grams[: len(low)] == low)])  # windows that begin with their minimizer
                twice = left[e - 1] > left[s]  # the minimizer occurs again behind such a window, as in periodic text
                yield emit(_RUNS, [low[s].view(np.int64), ids[lo + own], hashes[lo + own], s - ends[own], e - s, span_hash(prefix, s, e + length - 1).view(np.int64), twice.astype(np.int32)])

    return run


def _cut(length: int):
    """Rows (runs of one text, text): the bytes of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for text, want in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                raw = text.encode()
                for w in want:
                    for o, v in zip(out, (w["m"], w["c"], w["sub"], raw[w["start"] : w["start"] + w["n"] + length - 1])):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["m", "c", "sub", "bytes"])

    return run


_FOUND = pa.schema([("m", pa.int64()), ("c", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("bucket", pa.int32()), ("lists", pa.binary())])
_FOUND_DDL = "m long, c long, lo int, hi int, bucket int, lists binary"
_ENTRY = np.dtype([("f", "<u8"), ("g", "<u8"), ("c", "<i8"), ("start", "<i4"), ("hit", "<i4")])


def _ranges(run: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first, past the last) of the maximal stretches of sorted windows."""
    if not len(run):
        return run, start, start
    edge = np.flatnonzero((np.diff(run) != 0) | (np.diff(start) != 1)) + 1
    lo, hi = np.append(0, edge), np.append(edge, len(run)) - 1
    return run[lo], start[lo], start[hi] + 1


def _buckets(subs: int) -> int:
    """Places that look up the lists of a minimizer: each gets about what MERGED shards hold, however many there are."""
    return max(1, -(-subs // MERGED))


def _shards(length: int, limit: int):
    """Rows (m, c, sub, bytes, subs), sorted by (m, sub): the repeated windows of each run as ranges.

    For minimizers dealt to several shards, also each shard's distinct windows, as lists sorted by fingerprint.
    """

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        run, start, hit, lead = repeated_windows([r[3] for r in rows], length)
        m, c = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        own, lo, hi = _ranges(run[hit], start[hit])
        out = [[m[own], c[own], lo, hi, np.full(len(own), -1), pa.nulls(len(own), pa.binary())]]
        subs = rows[0][4]
        if subs > 1:
            raw = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
            base = np.cumsum([0] + [len(r[3]) for r in rows])[run] + start
            entry = np.zeros(int(lead.sum()), _ENTRY)
            at = base[lead]
            entry["f"] = span_hash(prefix_hash(raw), at, at + length)
            entry["g"] = span_hash(prefix_hash(raw ^ np.uint8(0x5A)), at, at + length)
            entry["c"], entry["start"], entry["hit"] = c[run[lead]], start[lead], hit[lead]
            entry = entry[np.argsort(entry["f"], kind="stable")]
            n = _buckets(subs)
            cuts = np.searchsorted(entry["f"], [np.uint64(((i << 64) // n)) for i in range(1, n)])
            lists = [x.tobytes() for x in np.split(entry, cuts)]
            full = [i for i, x in enumerate(lists) if x]
            n = len(full)
            out.append([np.full(n, m[0]), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), full, pa.array([lists[i] for i in full], pa.binary())])
        return pa.Table.from_batches([emit(_FOUND, o) for o in out]).combine_chunks().to_batches() or [emit(_FOUND, [[]] * 6)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                other = held and (row[0], row[2]) != (held[-1][0], held[-1][2])
                if other and (size >= limit or row[4] > 1 or held[-1][4] > 1):
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield from solve(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (m, bucket, lists), sorted by (m, bucket): windows of one list that binary search finds in another."""

    def solve(m: int, lists: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate([x["f"] for x in lists]), kind="stable")
        found = []
        for x in lists:
            n = np.searchsorted(every, x["f"], "right") - np.searchsorted(every, x["f"], "left")
            found.append(x[n > 1])
        same = np.concatenate(found)
        order = np.lexsort((same["g"], same["f"]))
        same = same[order]
        equal = (same["f"][1:] == same["f"][:-1]) & (same["g"][1:] == same["g"][:-1])
        hit = np.append(False, equal) | np.append(equal, False)
        same = np.sort(same[hit & (same["hit"] == 0)], order=["c", "start"])
        own, lo, hi = _ranges(same["c"], same["start"])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), m), pa.int64()), pa.array(own, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["m", "c", "lo", "hi"])

    at, lists = None, []
    for batch in batches:
        for m, bucket, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (m, bucket) != at and lists:
                yield solve(at[0], lists)
                lists = []
            at = (m, bucket)
            lists.append(np.frombuffer(raw, _ENTRY))
    if lists:
        yield solve(at[0], lists)


_DONE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_bytes", pa.binary())])


def _remove(with_bytes: bool):
    schema = _DONE if with_bytes else pa.schema(list(_DONE)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(1))
            marks = batch.column(2)
            rows = []
            for i in range(batch.num_rows):
                own = raw[at[i] : at[i + 1]]
                kept, spans = own, 0
                if marks[i].is_valid and len(marks[i].values):
                    pairs = marks[i].values
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, pairs.field(0).to_numpy(zero_copy_only=False), 1)
                    np.add.at(edge, pairs.field(1).to_numpy(zero_copy_only=False), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = own[~gone]
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                data = kept.tobytes()
                rows.append((len(own), len(own) - len(kept), spans, hashlib.sha256(data).hexdigest(), data)[: len(schema) - 1])
            yield emit(schema, [batch.column(0), *zip(*rows)] if rows else [[]] * len(schema))

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, split: int = SPLIT, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes) for every row of ``docs``.

    All strings are judged on the input. Null texts are empty; texts shorter than ``length`` bytes stay whole. A
    row repeated with the same doc_id and text repeats all of it. A null doc_id stays null. Other columns are not
    looked at. What is kept are bytes: a removal may cut a character in two. Long texts are cut at no place. No rows, no result.
    """
    scratch = Scratch(spark, "suffixes")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("th"))
    runs = scratch.save(keyed.where(F.octet_length("text") >= length).select("id", "text", "th").mapInArrow(lean(_runs(length, gram)), _RUNS_DDL), "runs")
    groups = runs.groupBy("m").agg(F.count("*").alias("k"), F.max("twice").alias("twice"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("k + twice > 1")
    groups = scratch.save(groups.select("m", ((F.col("c0") != F.col("c1")) | (F.col("k") == 1)).alias("open")), "groups")
    shared = scratch.save(runs.join(groups, "m"), "shared")
    scratch.drop("runs")
    size = F.col("n") + (length - 1)
    whole = shared.where(~F.col("open")).select("id", "th", F.col("start").alias("s"), (F.col("start") + size).alias("e"))
    opened = shared.where("open")

    contents = opened.groupBy("m", "c").agg(F.count("*").alias("k"), F.min(F.struct("id", "th", "start", "n")).alias("at"))
    contents = scratch.save(contents.select("m", "c", (F.col("k") > 1).alias("copied"), "at.*"), "contents")
    large = scratch.save(contents.groupBy("m").agg(F.ceil(F.sum(size.cast("long")) / split).cast("int").alias("subs")).where("subs > 1"), "large")
    dealt = contents.join(large, "m", "left").withColumn("subs", F.coalesce("subs", F.lit(1))).withColumn("sub", F.pmod("c", F.col("subs")).cast("int"))
    dealt = scratch.save(dealt, "dealt")
    wanted = dealt.groupBy("id", "th").agg(F.collect_list(F.struct("m", "c", "sub", "start", "n")).alias("want"))
    pieces = wanted.join(keyed.select("id", "th", "text"), ["id", "th"]).select("want", "text")
    pieces = scratch.save(pieces.mapInArrow(lean(_cut(length)), "m long, c long, sub int, bytes binary"), "pieces")
    placed = pieces.join(large, "m", "left").withColumn("subs", F.coalesce("subs", F.lit(1)))
    sorted_ = placed.repartition("m", "sub").sortWithinPartitions("m", "sub", "c").select("m", "c", "sub", "bytes", "subs")
    found = scratch.save(sorted_.mapInArrow(lean(_shards(length, shard)), _FOUND_DDL), "found")
    lists = found.where("bucket >= 0").select("m", "bucket", "lists").repartition("m", "bucket").sortWithinPartitions("m", "bucket")
    across = lists.mapInArrow(lean(_merge), "m long, c long, lo int, hi int")
    ranges = found.where("bucket < 0").select("m", "c", "lo", "hi").unionByName(across).groupBy("m", "c").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    copied = F.when(F.col("copied"), F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi")))).otherwise(F.col("ranges"))
    known = scratch.save(contents.select("m", "c", "n", "copied").join(ranges, ["m", "c"], "left").select("m", "c", copied.alias("ranges")).where("ranges is not null"), "known")
    back = opened.select("m", "c", "id", "th", "start").join(known, ["m", "c"]).select("id", "th", "start", F.explode("ranges").alias("r"))
    marks = whole.unionByName(back.select("id", "th", (F.col("start") + F.col("r.lo")).alias("s"), (F.col("start") + F.col("r.hi") + (length - 1)).alias("e")))
    by_doc = scratch.save(marks.groupBy("id", "th").agg(F.collect_list(F.struct("s", "e")).alias("marks")), "by_doc")
    scratch.drop("shared", "pieces", "dealt", "found", "known", "contents")
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_bytes
    joined = keyed.join(by_doc, ["id", "th"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(lean(_remove(with_bytes)), ddl)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, i, md5(b[i:i + {LENGTH - 1}]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - {LENGTH - 2})) AS i FROM n)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CAST(i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > {LENGTH} AS INT) AS new FROM m)),
s AS (SELECT doc_id, min(i) AS s, max(i) + {LENGTH - 1} AS e FROM g GROUP BY doc_id, g),
edges AS (SELECT doc_id, e + 1 AS a, lead(s) OVER (PARTITION BY doc_id ORDER BY s) - 1 AS z FROM (SELECT doc_id, s, e FROM s UNION ALL SELECT doc_id, 0, 0 FROM n)),
kept AS (SELECT doc_id, string_agg(hex(b[a:coalesce(z, n)]), '' ORDER BY a) AS x, CAST(sum(greatest(coalesce(z, n) - a + 1, 0)) AS BIGINT) AS c FROM edges JOIN n USING (doc_id) WHERE a <= coalesce(z, n) GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_bytes, n.n - coalesce(k.c, 0) AS n_removed, (SELECT count(*) FROM s WHERE s.doc_id = n.doc_id) AS n_spans, sha256(unhex(coalesce(k.x, ''))) AS kept_sha256
FROM n LEFT JOIN kept k USING (doc_id)
"""
