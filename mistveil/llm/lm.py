"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

The probability of a token is that of its class given the two tokens before, times that of the token in its class.

* Classes: the 4096 most frequent words are in 32 classes of like endings, all others in 32 classes by their ending. A class has a
  softmax over a bias, a feature of the word before (n-gram), one of the word before that (skip), and a hashed feature
  of both; in these, words go by 128 buckets.
* Words: the softmax over all words of a class, c(w) their training count, is
  (c(w) + 1) * exp(feature of context and word), normalised over the class. The features are hashed n-grams of the word before and the
  word, one for every pair of the training text. Behind a word that was not seen in training the context is the
  word before that (skip); these features are learned behind words seen once. Words of a class without a feature in a context
  share what is left, so the sum over a class needs the features of the context only.

Features of words are as many as the distinct pairs of the training text. They are kept nowhere as a whole: they are
dealt by the hash of their context, and learned there by rounds of gradient steps over the diagonal of the curvature,
under a Gaussian prior. The contexts of very frequent words are dealt by class and, where these are still too many pairs for one place, by
word; then each round adds up the parts of the sum over the class.

1. Documents are cut into chunks where they are read. A chunk is one row: its distinct words, and its tokens as places among them.
2. Chunks send their words and training counts to places by hash, which add them up and send the totals back.
3. With the most frequent words known, chunks count (contexts, class); the weights of classes are trained on the sums,
   each round a job whose parts of the gradient have a fixed size.
4. Chunks send their distinct pairs with counts to the place of their context, where features are learned; for each pair its
   part of the score comes back.

Words are 64-bit hashes, of which a pair has 48 bits of its context and 24 of its word. Everything that is sent is packed, one
row for each chunk and place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import emit, lean, mix, prefix_hash, Scratch, span_hash, steps, table, utf8, word_spans

FOLDS, HELD_OUT = 7, 2
HEAD, CLASSES, OWN = 4096, 32, 63
ENDINGS = 64
#: Contexts: the start, OWN words, and endings.
BUCKETS = 1 + OWN + ENDINGS
ALL_CLASSES = CLASSES + ENDINGS // 2
PAIRS = 4096
#: Bytes of text in a chunk of documents, and for which there is a place that words or pairs are sent to.
CHUNK, PLACE = 2 << 20, 2 << 20
#: Bytes of text for which there is a partition of what is sent.
PART = 12 << 20
ROUNDS, RATE = 12, 0.4
#: Variance of the prior of a word's features, rounds, and the largest step of one.
VARIANCE, STEPS, LONGEST = 8.0, 12, 1.5
#: Training pairs of one context and class, by the words' counts, beyond which they are dealt to several places.
HOT = 1 << 19
FAN_IN = 256
END, START, SKIP = np.uint64(0x5EED0E0D5EED0E0D), np.uint64(0x57A2757A2757A275), np.uint64(0x5C195C195C195C19)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A pair is named by the higher 48 bits of its context's hash and the lower 24 of its word's. Words that agree in theirs, in a context and
#: class, share a feature.
CONTEXT_SHIFT, WORD_BITS = np.uint64(16), np.uint64((1 << 24) - 1)
#: What a feature adds to a score comes back in steps of 2 ** -16 (of the natural logarithm), whose highest byte is next to nothing.
GRAIN = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?*#$%&|<>\"'()"]] = True


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and endings of all tokens, each text followed by the end, and where texts begin and end among them."""
    raw = _LOWER[raw]
    s, e, doc = word_spans(raw, at)
    words = span_hash(prefix_hash(raw), s, e)
    a, b = e - 1, np.maximum(e - 2, s)
    mark = _MARKS[raw[a]] if len(e) else np.zeros(0, bool)
    for _ in range(3):  # up to three marks are not part of the ending
        back = (_MARKS[raw[a]] if len(e) else mark) & (a > s)
        a = a - back
    b = np.maximum(a - 1, s)
    ending = ((raw[a].astype(np.int64) * 131 + raw[b]) * 2654435761 >> 7) % (ENDINGS // 2) * 2 + mark if len(e) else np.zeros(0, np.int64)
    n = len(at) - 1
    ends = np.searchsorted(doc, np.arange(n), "right")
    places = ends + np.arange(n)
    out, codes = np.full(len(words) + n, END, np.uint64), np.zeros(len(words) + n, np.int64)
    word = np.ones(len(out), bool)
    word[places] = False
    out[word], codes[word] = words, ending
    return out, codes, np.concatenate([[0], places + 1])


# Rows of packed arrays ------------------------------------------------------------------

_ROW = pa.schema([("kind", pa.int8()), ("chunk", pa.int64()), ("place", pa.int64()), ("data", pa.binary())])
_ROW_DDL = "kind byte, chunk long, place long, data binary"
_CHUNK, _TOTAL, _TOP, _DOCS, _PAIRS, _PART, _HOT, _HOT_PART = range(8)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed string, byte by byte of their values: the high bytes of small or sorted numbers become next to nothing."""
    planes = (np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in arrays)
    raw = np.array([len(x) for x in arrays], "<i8").tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, *types: str) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 8 * len(types)
    for n, t in zip(np.frombuffer(raw, "<i8", len(types)), map(np.dtype, types)):
        planes = np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(n))
        at += n * t.itemsize
    return out


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple]]:
    """Rows that follow one another and agree in a column, as lists of (kind, chunk, place, data)."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[column] != held[-1][column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _together(rows: Iterator[tuple], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (kind, chunk, place, data) as batches of about ``limit`` bytes; a batch of one small row would cost the JVM more than the row."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size >= limit:
            yield emit(_ROW, list(zip(*held)))
            held, size = [], 0
    if held:
        yield emit(_ROW, list(zip(*held)))


def _gathered(rows: DataFrame, by: str, parts: int) -> DataFrame:
    """Rows with those of one chunk or place together, in a number of partitions that follows the text."""
    return rows.select("kind", "chunk", "place", "data").repartition(parts, by).sortWithinPartitions(by, "kind", "place", "chunk")


def _split(place: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(place, first, past the last) of the stretches of sorted places."""
    edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
    for lo, hi in zip(edges[:-1], edges[1:]):
        if lo < hi:
            yield int(place[lo]), lo, hi


# Chunks and their words -----------------------------------------------------------------

_CHUNK_TYPES = ("<i8", "u1", "u1", "<i8", "<u4", "<u8", "u1", "<u4")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, text) -> one row a chunk: doc_id, has it one, fold (0: learned from, 1: held out, 2: no fold),
    where documents begin among the tokens, tokens, words, endings, training counts."""
    held: list[tuple] = []
    size, count = 0, 0

    def close() -> pa.RecordBatch:
        h, ending = (np.concatenate([x[i] for x in held]) for i in (3, 4))
        n = np.concatenate([np.diff(x[5]) for x in held])
        doc, has, fold = (np.concatenate([x[i] for x in held]) for i in range(3))
        words, first, ids = np.unique(h, return_index=True, return_inverse=True)
        counts = np.bincount(ids[np.repeat(fold == 0, n)], minlength=len(words))
        at = np.concatenate([[0], np.cumsum(n)])
        data = pack(doc, has, fold, at, ids.astype("<u4"), words, ending[first], counts.astype("<u4"))
        return emit(_ROW, [[_CHUNK], [TaskContext.get().partitionId() << 32 | count], [0], [data]])

    for batch in batches:
        raw, at = utf8(batch.column(2))
        doc = batch.column(0)
        ids, has = doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
        fold = np.where(has == 1, batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), 2).astype(np.uint8)
        for lo, hi in steps(at):
            h, ending, places = tokens(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            held.append((ids[lo:hi], has[lo:hi], fold[lo:hi], h, ending.astype(np.uint8), places))
            size += int(at[hi] - at[lo])
            if size >= CHUNK:
                yield close()
                held, size, count = [], 0, count + 1
    if held:
        yield close()


def _words_out(places: int):
    """Chunks -> their words with endings and training counts, by place: the high bits of the hash, so that places are in the order of words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for chunk, data in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                words, ending, n = unpack(data, *_CHUNK_TYPES)[5:]
                for place, lo, hi in _split(_high(words, places)):
                    yield _CHUNK, chunk, place, pack(words[lo:hi], ending[lo:hi], n[lo:hi])

    return lambda batches: _together(rows(batches))


def _high(h: np.ndarray, places: int) -> np.ndarray:
    """Places are a power of two."""
    bits = places.bit_length() - 1
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _together(_total_rows(batches))


def _total_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Words of all chunks, by place -> their totals, for each chunk; and the HEAD most frequent ones of the place with sums by ending."""
    for rows in _groups(batches, 2):
        parts = [unpack(r[3], "<u8", "u1", "<u4") for r in rows]
        words, first, own = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        ending = np.concatenate([p[1] for p in parts])[first]
        total = np.bincount(own, np.concatenate([p[2] for p in parts])).astype(np.int64)
        lo = 0
        for row, p in zip(rows, parts):
            yield _TOTAL, row[1], row[2], pack(total[own[lo : lo + len(p[0])]].astype("<u8"))
            lo += len(p[0])
        seen = np.flatnonzero(total)
        top = seen[np.lexsort((words[seen].view(np.int64), -total[seen]))[:HEAD]]
        sums = [np.bincount(ending[seen], x, ENDINGS).astype("<i8") for x in (total[seen], np.ones(len(seen)))]
        yield _TOP, 0, rows[0][2], pack(words[top], ending[top], total[top].astype("<u8"), *sums)


def _tops(sums: bool):
    """Rows of the most frequent words (h, ending, n), or of sums by ending (-, ending, n, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("ending", pa.int64()), ("n", pa.int64()), ("v", pa.int64())])
        for batch in batches:
            for data in batch.column(3).to_pylist():
                h, ending, n, n_sum, v_sum = unpack(data, "<u8", "u1", "<u8", "<i8", "<i8")
                if sums:
                    yield emit(schema, [np.zeros(ENDINGS, np.int64), np.arange(ENDINGS), n_sum, v_sum])
                else:
                    yield emit(schema, [h.view(np.int64), ending.astype(np.int64), n.astype(np.int64), np.ones(len(h), np.int64)])

    return run


class Vocabulary:
    """The head words, sorted by hash: their counts, endings, classes and places in a class, and context buckets."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        """rows: (h, ending, n), the most frequent first; the end must be among them."""
        h = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        ending, n = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
        order = np.argsort(h)
        rank = np.arange(len(h))
        kind = np.empty(len(h), np.int64)
        by_ending = np.lexsort((rank, ending))
        kind[by_ending] = np.arange(len(h)) * CLASSES // max(1, len(h))
        self.h, self.n = h[order], n[order]
        self.cls = kind[order]
        self.bucket = np.where(rank < OWN, 1 + rank, 1 + OWN + ending)[order]

    def codes(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """Places among the head words, and from HEAD on the endings of others."""
        ending = ending.astype(np.int64)
        if not len(self.h):
            return HEAD + ending
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, HEAD + ending)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Class and context bucket of each code."""
        cls, bucket = np.zeros(HEAD + ENDINGS, np.int64), np.zeros(HEAD + ENDINGS, np.int64)
        cls[: len(self.h)], bucket[: len(self.h)] = self.cls, self.bucket
        cls[HEAD:], bucket[HEAD:] = CLASSES + np.arange(ENDINGS) // 2, 1 + OWN + np.arange(ENDINGS)
        return cls, bucket


def contexts(bucket: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets one and two places before each token; 0 before the start of its text."""
    one, two = np.zeros_like(bucket), np.zeros_like(bucket)
    one[1:], two[2:] = bucket[:-1], bucket[:-2]
    one[at[:-1]] = 0
    two[at[:-1]] = 0
    second = at[:-1] + 1
    two[second[second < at[1:]]] = 0
    return one, two


# Counts of classes ----------------------------------------------------------------------

_COUNTS_DDL = "block long, task long, wide boolean, counts binary"


def _class_counts(vocabulary: Vocabulary):
    """Chunks -> counts of (bucket before; bucket before that, class) over the training tokens of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("task", pa.int64()), ("wide", pa.bool_()), ("counts", pa.binary())])
        cls, bucket = vocabulary.tables()
        counts = np.zeros(BUCKETS * BUCKETS * ALL_CLASSES, np.int32)
        for batch in batches:
            for data in batch.column(3).to_pylist():
                _, _, fold, at, ids, words, ending, _ = unpack(data, *_CHUNK_TYPES)
                codes = vocabulary.codes(words, ending)
                one, two = contexts(bucket[codes][ids], at)
                learned = np.repeat(fold == 0, np.diff(at))
                counts += np.bincount(((one * BUCKETS + two) * ALL_CLASSES + cls[codes][ids])[learned], minlength=len(counts)).astype(np.int32)
        blocks = counts.reshape(BUCKETS, -1)
        some = np.flatnonzero(blocks.any(axis=1))
        yield emit(schema, [some, [TaskContext.get().partitionId()] * len(some), [False] * len(some), [blocks[i].tobytes() for i in some]])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, task, wide, counts), sorted by the first two: one row for each, with the sum as 64-bit integers."""
    schema = pa.schema([("block", pa.int64()), ("task", pa.int64()), ("wide", pa.bool_()), ("counts", pa.binary())])
    key, total = None, None
    for batch in batches:
        for block, task, wide, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (block, task):
                if key is not None:
                    yield emit(schema, [*([k] for k in key), [True], [total.tobytes()]])
                key, total = (block, task), 0
            total = total + np.frombuffer(raw, np.int64 if wide else np.int32).astype(np.int64)
    if key is not None:
        yield emit(schema, [*([k] for k in key), [True], [total.tobytes()]])


def sum_counts(parts: DataFrame, tasks: int) -> DataFrame:
    """Sums of (block, task, wide, counts) over tasks, as a tree: one place adds up what about FAN_IN tasks have counted."""
    keys = ["block", "task"]
    while True:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("task", F.pmod("task", F.lit(max(1, tasks))))
        parts = parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(_summed), _COUNTS_DDL)
        if tasks <= 1:
            return parts.select("block", "counts")


# Weights of classes ---------------------------------------------------------------------


def pair_slot(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return ((one * 1_000_003 + two) * 2_654_435_761 >> 11) % PAIRS


def new_weights() -> dict[str, np.ndarray]:
    return {"bias": np.zeros((1, ALL_CLASSES)), "one": np.zeros((BUCKETS, ALL_CLASSES)), "two": np.zeros((BUCKETS, ALL_CLASSES)), "pair": np.zeros((PAIRS, ALL_CLASSES))}


def class_logs(w: dict, one: int) -> np.ndarray:
    """log P(class) for each bucket two places before, given the bucket one place before."""
    two = np.arange(BUCKETS)
    logits = w["bias"] + w["one"][one] + w["two"] + w["pair"][pair_slot(np.full(BUCKETS, one), two)]
    top = logits.max(axis=1, keepdims=True)
    return logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))


def part_gradient(w: dict, one: int, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the log likelihood of one block of counts, stacked on the diagonal of its curvature."""
    n = counts.reshape(BUCKETS, ALL_CLASSES)
    p = np.exp(class_logs(w, one))
    total = n.sum(axis=1, keepdims=True)
    g, h = n - total * p, total * p * (1 - p)
    out = {k: np.zeros((2, *w[k].shape)) for k in w}
    slot = pair_slot(np.full(BUCKETS, one), np.arange(BUCKETS))
    for i, x in enumerate((g, h)):
        out["bias"][i, 0] = out["one"][i, one] = x.sum(axis=0)
        out["two"][i] = x
        np.add.at(out["pair"][i], slot, x)
    return out


def _gradients(w: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(*(c.to_pylist() for c in batch.columns)):
                for k, x in part_gradient(w, block, np.frombuffer(raw, np.int64)).items():
                    total[k] = total[k] + x if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], names=["name", "part"])

    return run


def train(counts: DataFrame, sizes: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights after some rounds of distributed gradients over the written table ``counts`` (block, counts).

    The biases begin at the logarithms of the sizes of classes.
    """
    w = new_weights()
    w["bias"][0] = np.log(sizes)
    for _ in range(rounds):
        total = {k: np.zeros((2, *x.shape)) for k, x in w.items()}
        for row in counts.mapInArrow(lean(_gradients(w)), "name string, part binary").toLocalIterator():
            total[row["name"]] += np.frombuffer(bytes(row["part"]), np.float32).reshape(total[row["name"]].shape)
        for k, (g, h) in total.items():
            shrink = 0 if k == "bias" else 0.1 * w[k]
            w[k] = w[k] + np.clip(RATE * (g - shrink) / (h + 1.0), -1, 1)
    return w


# Features of words ----------------------------------------------------------------------


class Hot:
    """The contexts of very frequent words, sorted by hash, and to how many places the pairs of each class are dealt."""

    def __init__(self, vocabulary: Vocabulary, starts: int, sizes: np.ndarray):
        own = vocabulary.n > HOT
        h = np.concatenate([vocabulary.h[own], skip_context(vocabulary.h[own]), [START]]).astype(np.uint64) >> CONTEXT_SHIFT
        n = np.concatenate([vocabulary.n[own], vocabulary.n[own], [starts]])
        h, n = h[n > HOT], n[n > HOT]
        order = np.argsort(h)
        self.h, share = h[order], sizes / sizes.sum()
        self.parts = 1 + (n[order][:, None] * share / HOT).astype(np.int64)

    def parts_of(self, context: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """In how many parts the pairs of (context, class) are; 0: with all pairs of the context."""
        out = np.zeros(len(context), np.int64)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, context), len(self.h) - 1)
            own = np.flatnonzero(self.h[at] == context)
            out[own] = self.parts[at[own], cls[own]]
        return out

    def place(self, context: np.ndarray, cls: np.ndarray, word: np.ndarray, places: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = mix(context ^ _ODD)
            parts = self.parts_of(context, cls)
            own = np.flatnonzero(parts)
            part = word[own].astype(np.int64) % parts[own]
            key[own] = mix(key[own] + (cls[own].astype(np.uint64) + np.uint64(1)) * _ODD + part.astype(np.uint64))
        return _high(key, places)


def skip_context(h: np.ndarray) -> np.ndarray:
    return mix(h ^ SKIP)


def step(f: np.ndarray, q: np.ndarray, n: np.ndarray, total: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Features after one step by gradient over curvature. n: the pair's count, q: its share of the class without features,
    total: training tokens of its context and class, z: the sum over the class."""
    p = q * np.exp(f) / z
    return f + np.clip((n - total * p - f / VARIANCE) / (total * p * (1 - p) + 1 / VARIANCE), -LONGEST, LONGEST)


def learn(q: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of pairs in groups of one context and class that begin at ``first``, and the logarithm of each group's sum."""
    size = np.diff(np.append(first, len(q)))
    total = np.repeat(np.add.reduceat(n, first), size).astype(np.float64)
    f, z = np.zeros(len(q)), np.ones(len(first))
    for _ in range(STEPS):
        f = step(f, q, n, total, np.repeat(z, size))
        z = 1 + np.add.reduceat(q * np.expm1(f), first)
    return f, np.log(z)


_PAIR_TYPES = ("<u8", "<u4", "<u4", "u1", "<u4", "<u8")
_KNOWN_TYPES = (*_CHUNK_TYPES[:-1], "<u8")


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk and the totals of its words -> the chunk, with totals in place of its own counts."""
    for rows in _groups(batches, 1):
        own = unpack(rows[0][3], *_CHUNK_TYPES)[:-1]
        total = np.concatenate([unpack(r[3], "<u8")[0] for r in rows[1:]])
        yield emit(_ROW, [[_CHUNK], [rows[0][1]], [0], [pack(*own, total)]])


class Pairs:
    """The distinct pairs of a chunk in the order of their places, and which of them each token has."""

    def __init__(self, data: bytes, cls: np.ndarray, vocabulary: Vocabulary, hot: Hot, places: int):
        self.doc, self.has, self.fold, self.at, ids, words, ending, total = unpack(data, *_KNOWN_TYPES)
        self.ids, self.total, self.size = ids.astype(np.int64), total.astype(np.int64), np.diff(self.at)
        self.codes = vocabulary.codes(words, ending)
        self.cls = cls[self.codes]
        ids, m, at = self.ids, len(words), self.at
        # Contexts: places of words, m for the start; from m + 1 on the same for skips.
        u1, u2 = np.full(len(ids), m), np.full(len(ids), m)
        u1[1:], u2[2:] = ids[:-1], ids[:-2]
        u1[at[:-1]] = u2[at[:-1]] = m
        second = at[:-1] + 1
        u2[second[second < at[1:]]] = m
        seen = np.append(self.total, 2)[u1]  # the start counts as seen
        learned = np.repeat(self.fold == 0, self.size)
        more = np.flatnonzero(learned & (seen <= 1))
        code = np.concatenate([np.where(seen > 0, u1, m + 1 + u2) * m + ids, (m + 1 + u2[more]) * m + ids[more]])
        pair, of = np.unique(code, return_inverse=True)
        count = np.bincount(of, np.concatenate([learned, np.ones(len(more))]))
        hashes = np.concatenate([words, [START], skip_context(np.append(words, START))]) >> CONTEXT_SHIFT
        context, word = hashes[pair // m], pair % m
        low = (words[word] & WORD_BITS).astype("<u4")
        place = hot.place(context, self.cls[word], low, places)
        # Pairs are sorted by context already; a sort of two-byte places is one by digits.
        order = np.argsort(place.astype(np.uint16) if places <= 1 << 16 else place, kind="stable")
        self.place, self.context, self.low, self.word, self.count = place[order], context[order], low[order], word[order], count[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.entry = back[of[: len(ids)]]


def _pairs_out(cls: np.ndarray, vocabulary: Vocabulary, hot: Hot, places: int):
    """Chunks -> their pairs by place: contexts, how many pairs each has, and of the pairs the word, class, training count, and the word's total."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for chunk, data in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                p = Pairs(data, cls, vocabulary, hot, places)
                kind, total, count = p.cls[p.word].astype(np.uint8), p.total[p.word].astype("<u8"), p.count.astype("<u4")
                for to, lo, hi in _split(p.place):
                    edge = np.append(np.flatnonzero(np.append(True, p.context[lo + 1 : hi] != p.context[lo : hi - 1])), hi - lo)
                    own = pack(p.context[lo:hi][edge[:-1]], np.diff(edge).astype("<u4"), p.low[lo:hi], kind[lo:hi], count[lo:hi], total[lo:hi])
                    yield _PAIRS, chunk, to, own

    return lambda batches: _together(rows(batches))


_DOC_TYPES = ("<i8", "u1", "u1", "<i8", "<i8", "<f8", "<f8", "<u4")


def _docs_out(w: dict, key: str, cls: np.ndarray, bucket: np.ndarray, vocabulary: Vocabulary, hot: Hot, n: int, v: int, sizes: np.ndarray, places: int):
    """Chunks -> their documents: the score without what features of words add, and the pairs of each, as a bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = class_table(key, w)
        for batch in batches:
            for chunk, data in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                p = Pairs(data, cls, vocabulary, hot, places)
                ids, at = p.ids, p.at
                base, share = np.log10(p.total + 1.0), np.log10((p.total + 1.0) / sizes[p.cls])
                one, two = contexts(bucket[p.codes][ids], at)
                score = np.add.reduceat(classes[one, two, p.cls[ids]].astype(np.float64) + share[ids], at[:-1])
                base_score = np.add.reduceat(base[ids], at[:-1]) - p.size * np.log10(float(n + v + 1))
                known = np.add.reduceat((p.total[ids] > 0).astype(np.int64), at[:-1])
                entry = np.sort(np.repeat(np.arange(len(p.doc)) * len(p.word), p.size) + p.entry) - np.repeat(np.arange(len(p.doc)) * len(p.word), p.size)
                gaps = np.diff(entry, prepend=0)
                gaps[at[:-1]] = entry[at[:-1]]
                yield emit(_ROW, [[_DOCS], [chunk], [0], [pack(p.doc, p.has, p.fold, at, known, base_score, score, gaps.astype("<u4"))]])

    return run


def _learn(hot: Hot, sizes: np.ndarray):
    """Pairs of all chunks, by place -> for each chunk what every pair adds to the score. Of pairs that are dealt to several places
    that part is 0 here; they are returned as rows (context, class) with counts, totals, and where they came from."""

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rows in _groups(batches, 2):
            parts = [unpack(r[3], *_PAIR_TYPES) for r in rows]
            lengths = [len(p[2]) for p in parts]
            context = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
            word, cls, n, total = (np.concatenate([p[i] for p in parts]) for i in range(2, 6))
            order = np.lexsort((word, cls, context))
            c, k, x = context[order], cls[order], word[order]
            new_group = np.append(True, (c[1:] != c[:-1]) | (k[1:] != k[:-1]))
            new_pair = new_group | np.append(True, x[1:] != x[:-1])
            at = np.flatnonzero(new_pair)
            count = np.add.reduceat(n[order].astype(np.int64), at)
            q = (total[order][at] + 1.0) / sizes[k[at]]
            group = np.cumsum(new_group)[at] - 1
            split = hot.parts_of(c[at], k[at]) > 1
            value = np.zeros(len(at))
            real = np.flatnonzero((count > 0) & ~split)
            logs = np.zeros(int(group[-1]) + 1)
            if len(real):
                first = np.flatnonzero(np.append(True, np.diff(group[real]) != 0))
                f, log_z = learn(q[real], count[real], first)
                value[real], logs[group[real][first]] = f, log_z
            value -= logs[group]
            pair = np.empty(len(order), np.int64)
            pair[order] = np.cumsum(new_pair) - 1
            out = grains(value)[pair]
            lo = 0
            for row, m in zip(rows, lengths):
                yield _PART, row[1], row[2], pack(out[lo : lo + m])
                lo += m
            if split.any():
                chunk = np.repeat(np.array([r[1] for r in rows], "<i8"), lengths)
                where = np.concatenate([np.arange(m) for m in lengths]).astype("<u4")
                entries = np.argsort(pair, kind="stable")  # in the order of pairs, and so of groups
                ends = np.searchsorted(pair[entries], np.arange(len(at) + 1))
                for _, lo, hi in _split(np.where(split, group, -1)):
                    if not split[lo]:
                        continue
                    held = entries[ends[lo] : ends[hi]]
                    data = pack(count[lo:hi], q[lo:hi], chunk[held], np.full(len(held), rows[0][2], "<i8"), where[held], (pair[held] - lo).astype("<u4"))
                    yield _HOT, int(c[at[lo]].view(np.int64)), int(k[at[lo]]), data

    return lambda batches: _together(solved(batches))


def grains(value: np.ndarray) -> np.ndarray:
    return np.round(value * GRAIN).astype("<i4")


_HOT_TYPES = ("<i8", "<f8", "<i8", "<i8", "<u4", "<u4")


def _hot_features(data: bytes, total: int, sums: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of a part have features, and these after as many steps as there are sums of earlier rounds."""
    n, q = unpack(data, *_HOT_TYPES)[:2]
    own = np.flatnonzero(n > 0)
    f = np.zeros(len(own))
    for z in sums:
        f = step(f, q[own], n[own], np.float64(total), z)
    return own, f


def _hot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("context", pa.int64()), ("cls", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        for _, context, cls, data in zip(*(c.to_pylist() for c in batch.columns)):
            yield emit(schema, [[context], [cls], [int(unpack(data, *_HOT_TYPES)[0].sum())]])


def _hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts (context, cls, data, total, sums) -> what each adds to the next sum over the class."""
    schema = pa.schema([("context", pa.int64()), ("cls", pa.int64()), ("z", pa.float64())])
    for batch in batches:
        for context, cls, data, total, sums in zip(*(c.to_pylist() for c in batch.columns)):
            own, f = _hot_features(data, total, sums)
            yield emit(schema, [[context], [cls], [float((unpack(data, *_HOT_TYPES)[1][own] * np.expm1(f)).sum())]])


def _hot_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _together(_hot_value_rows(batches))


def _hot_value_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The same -> what each pair adds to the score, for the chunks that it came from."""
    for batch in batches:
        for _, _, data, total, sums in zip(*(c.to_pylist() for c in batch.columns)):
            own, f = _hot_features(data, total, sums[:-1])
            n, _, chunk, place, where, pair = unpack(data, *_HOT_TYPES)
            value = np.full(len(n), -np.log(sums[-1]))
            value[own] += f
            own_grains = grains(value)
            order = np.argsort(chunk, kind="stable")
            for to, lo, hi in _split(chunk[order]):
                of = order[lo:hi]
                yield _HOT_PART, to, int(place[of[0]]), pack(where[of], own_grains[pair[of]])


def learn_hot(solved: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Features of pairs that are dealt to several places: in each round the parts of the sum over a class are added up."""
    parts = solved.where(F.col("kind") == _HOT)
    if parts.isEmpty():
        return None
    total = parts.mapInArrow(lean(_hot_counts), "context long, cls long, n long").groupBy("context", "cls").agg(F.sum("n").alias("total"))
    state = scratch.save(total.withColumn("sums", F.array(F.lit(1.0))), "hot0")
    named = parts.select(F.col("chunk").alias("context"), F.col("place").alias("cls"), "data")
    for i in range(1, STEPS + 1):
        z = named.join(state, ["context", "cls"]).mapInArrow(lean(_hot_sums), "context long, cls long, z double").groupBy("context", "cls").agg(F.sum("z").alias("z"))
        state = scratch.save(state.join(z, ["context", "cls"]).select("context", "cls", "total", F.array_append("sums", F.col("z") + 1).alias("sums")), f"hot{i}")
    return named.join(state, ["context", "cls"]).mapInArrow(lean(_hot_values), _ROW_DDL)


# Scores ---------------------------------------------------------------------------------

_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORED_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_tables: dict = {}


def class_table(key: str, w: dict) -> np.ndarray:
    """log10 P(class | contexts), once a worker."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = (np.stack([class_logs(w, b) for b in range(BUCKETS)]) / np.log(10)).astype(np.float32)
    return _tables[key]


def _scores(n: int):
    """Documents of a chunk and what its pairs add -> scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 1):
            doc, has, fold, at, known, base, score, gaps = unpack(rows[0][3], *_DOC_TYPES)
            parts = [unpack(r[3], "<i4")[0] for r in rows if r[0] == _PART]
            value = np.concatenate(parts).astype(np.float64)
            first = dict(zip((r[2] for r in rows if r[0] == _PART), np.cumsum([0, *map(len, parts)])))
            for r in rows:
                if r[0] == _HOT_PART:
                    where, more = unpack(r[3], "<u4", "<i4")
                    value[first[r[2]] + where] = more
            entry = np.cumsum(gaps, dtype=np.int64)
            before = np.append(0, entry)[at[:-1]]  # gaps begin anew with each document
            entry -= np.repeat(before, np.diff(at))
            score = score + np.add.reduceat(value[entry], at[:-1]) / (GRAIN * np.log(10))
            ids, out = pa.array(doc, pa.int64(), mask=has == 0), pa.array(fold == 1, pa.bool_(), mask=fold == 2)
            yield emit(_SCORED, [ids, out, np.diff(at), known, np.full(len(doc), n), base, score])

    return run


def score(spark: SparkSession, docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``.

    A null or empty text is the end alone; a long one is scored whole. A row without a doc_id has a null held_out and is not
    learned from; repeated rows are learned from and scored each, so they score alike. Words of equal counts are taken for
    head words by their hash. Other columns are not looked at. If there is nothing to learn from, all counts are 0
    and the end is the only head word. No rows, no result.
    """
    scratch = Scratch(spark, "lm")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == held_out).alias("held_out")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART))
    places = 1 << max(0, -(-size // PLACE) - 1).bit_length()
    x = scratch.save(docs.select("doc_id", out, "text").mapInArrow(lean(_chunks), _ROW_DDL), "x", large=True)

    words = _gathered(x.mapInArrow(lean(_words_out(places)), _ROW_DDL), "place", parts)
    totals = scratch.save(words.mapInArrow(lean(_totals), _ROW_DDL), "totals")
    ddl = "h long, ending long, n long, v long"
    tops = totals.where(F.col("kind") == _TOP)
    top = [tuple(r) for r in tops.mapInArrow(lean(_tops(False)), ddl).orderBy(F.desc("n"), "h").limit(HEAD).select("h", "ending", "n").collect()]
    by_ending = tops.mapInArrow(lean(_tops(True)), ddl).groupBy("ending").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    sums = {r["ending"]: (r["n"], r["v"]) for r in by_ending}
    n, v = (sum(t[i] for t in sums.values()) for i in (0, 1))
    end = int(END.view(np.int64))
    starts = next((t[2] for t in top if t[0] == end), 0)
    if end not in {t[0] for t in top}:  # its count is below all head words', or nothing is learned from
        learned = docs.where(~out).count()
        top, starts = [*top[: HEAD - 1], (end, 0, learned)], learned
    rare_n, rare_v = np.zeros(ENDINGS // 2), np.zeros(ENDINGS // 2)
    for e, (a, b) in sums.items():
        rare_n[e // 2] += a
        rare_v[e // 2] += b
    for _, e, c in top:
        rare_n[e // 2] -= c
        rare_v[e // 2] -= c > 0
    vocabulary = Vocabulary(top)
    sizes = np.concatenate([np.bincount(vocabulary.cls, vocabulary.n + 1, CLASSES), rare_n + rare_v + 1])
    sizes = np.maximum(sizes, 1)

    counted = scratch.save(x.mapInArrow(lean(_class_counts(vocabulary)), _COUNTS_DDL), "counted")
    tasks = (counted.agg(F.max("task")).first()[0] or 0) + 1
    w = train(scratch.save(sum_counts(counted, tasks), "sums"), sizes)
    w32 = {k: a.astype(np.float32) for k, a in w.items()}
    scratch.drop("counted", "sums")

    known = _gathered(x.unionByName(totals.where(F.col("kind") == _TOTAL)), "chunk", parts).mapInArrow(lean(_known), _ROW_DDL)
    known = scratch.save(known, "known", large=True)
    scratch.drop("x", "totals")
    scratch.release()
    hot = Hot(vocabulary, starts, sizes)
    cls, bucket = vocabulary.tables()
    pairs = _gathered(known.mapInArrow(lean(_pairs_out(cls, vocabulary, hot, places)), _ROW_DDL), "place", parts)
    solved = scratch.save(pairs.mapInArrow(lean(_learn(hot, sizes)), _ROW_DDL), "solved", large=True)
    scratch.release()
    found = known.mapInArrow(lean(_docs_out(w32, scratch.root, cls, bucket, vocabulary, hot, n, v, sizes, places)), _ROW_DDL)
    found = found.unionByName(solved.where(F.col("kind") == _PART))
    more = learn_hot(solved, scratch)
    return _gathered(found if more is None else found.unionByName(more), "chunk", parts).mapInArrow(lean(_scores(n)), _SCORED_DDL)


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, table(spark, sf_dir, "documents"))
