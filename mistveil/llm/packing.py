"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

The tokens are gone through once, in parallel. What the packing needs of them is a histogram of
piece lengths, at most ``limit`` numbers, so it runs on the driver in a time that does not depend
on the number of documents: a bin pattern is filled greedily, improved by best-two-fit, and used
for as many bins as its lengths last. Each piece then finds its place by its rank among the pieces
of its length: ranks inside an input partition come with the pieces, and the partitions' counts
are summed up by a window. No task sees more than its own pieces.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import emit, lean, Scratch, table

LIMIT = 1024
END_ID = 2
_SPECIAL = "<|endoftext|>"

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
_PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PLACED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

_encoders: dict = {}


def encoder(tokenizer: str, ranks: str):
    """text -> numpy ids. Ids are those of the tokenizers file ``tokenizer``.

    ``ranks`` is the same vocabulary for tiktoken, which gives the same ids four times as fast;
    texts that spell the special token go through the tokenizers library, which maps it to one id.
    """
    if (tokenizer, ranks) not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})
        plain = []  # loaded when it is needed

        def encode(text: str) -> np.ndarray:
            if _SPECIAL in text:
                plain.extend([] if plain else [Tokenizer.from_file(tokenizer)])
                return np.array(plain[0].encode(text, add_special_tokens=False).ids, np.uint32)
            return np.array(fast.encode_ordinary(text), np.uint32)

        _encoders[tokenizer, ranks] = encode
    return _encoders[tokenizer, ranks]


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """Pieces of n tokens: all of ``limit`` tokens but the first, which holds the rest."""
    first = n % limit or limit
    return [(0, first)] + [(a, a + limit) for a in range(first, n, limit)]


#: Least gaps, in tokens, that a replacement is tried on.
GAINS = (1, 2, 4, 8)


def plan_bins(counts: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (piece lengths of a bin, in order) and the number of bins of each.

    Small pieces that fill gaps early may be missing later, so the replacement is tried with the least gains ``GAINS``; the
    plan with the fewest bins is taken, the one that replaces most among equals. All of them replace: a gain is far below
    the gaps that greedy filling leaves. The lengths are at most ``limit`` numbers, so this takes seconds.
    """
    return min((_plan(counts, limit, gain) for gain in GAINS), key=lambda plan: sum(times for _, times in plan))


def _plan(counts: np.ndarray, limit: int, gain: int) -> list[tuple[tuple[int, ...], int]]:
    """``counts[l]`` is the number of pieces of length l. A bin starts with the longest piece left and
    takes the longest that fits until none does. While there is a gap of ``gain`` or more, its shortest piece is replaced
    by the two unpacked pieces that fill the widened gap best, if these fill more.
    """
    left = counts.astype(np.int64).copy()
    patterns = []
    while len(lengths := np.flatnonzero(left)):
        bin_ = [int(lengths[-1])]
        left[bin_[0]] -= 1
        gap = limit - bin_[0]
        while gap > 0 and len(fits := np.flatnonzero(left[1 : gap + 1])):
            bin_.append(int(fits[-1]) + 1)
            left[bin_[-1]] -= 1
            gap -= bin_[-1]
        while gap >= gain and len(bin_) > 1:
            small = min(bin_[1:])
            pair = _best_pair(left, small, gap + small)
            if pair is None:
                break
            bin_.remove(small)
            left[small] += 1
            for x in pair:
                bin_.append(x)
                left[x] -= 1
            gap += small - sum(pair)
        use = Counter(bin_)
        times = 1 + min(int(left[x]) // k for x, k in use.items())
        for x, k in use.items():
            left[x] -= k * (times - 1)
        patterns.append((tuple(sorted(bin_, reverse=True)), times))
    return patterns


def _best_pair(left: np.ndarray, small: int, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum over ``small`` and at most ``room``."""
    there = left > 0
    for total in range(room, small, -1):
        both = there[1:total] & there[total - 1 : 0 : -1]
        if total % 2 == 0 and left[total // 2] < 2:
            both[total // 2 - 1] = False
        at = np.flatnonzero(both)
        if len(at):
            return int(at[0]) + 1, total - int(at[0]) - 1
    return None


def placements(patterns: list[tuple[tuple[int, ...], int]], limit: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) in the order of ranks."""
    out: dict[int, list] = {}
    taken = np.zeros(limit + 1, np.int64)
    sequence = 0
    for bin_, times in patterns:
        offset = 0
        for x in bin_:
            out.setdefault(x, []).append((int(taken[x]), sequence, offset))
            taken[x] += times
            offset += x
        sequence += times
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def _tokenize(files: tuple[str, str], limit: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files)
        part = TaskContext.get().partitionId()
        seen = [0] * (limit + 1)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                for k, (a, b) in enumerate(cut(len(ids), limit)):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, seen[b - a]))
                    seen[b - a] += 1
            yield emit(_PIECES, list(zip(*rows)) if rows else [[]] * len(_PIECES))

    return run


def _place(where: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    rows = where[int(length[own[0]])]
                    k = np.searchsorted(rows[:, 0], rank[own], "right") - 1
                    sequence[own] = rows[k, 1] + rank[own] - rows[k, 0]
                    offset[own] = rows[k, 2]
            yield emit(_PLACED, [*(batch.column(i) for i in range(5)), sequence, offset])

    return run


def pack(spark: SparkSession, docs: DataFrame, limit: int = LIMIT, end_id: int = END_ID, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece of every document, with its sequence and its place in it.

    Each document is its text's ids and then ``end_id``. A null or empty text is ``end_id`` alone; a long one is cut
    into pieces of ``limit`` tokens, the first of which may be shorter; a null doc_id stays null; repeated rows are packed once each; ties in length go by input order. No input,
    no rows. Columns beside doc_id and text are not looked at.
    """
    scratch = Scratch(spark, "packing")
    files = tokenizer or default_tokenizer()
    pieces = scratch.save(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_tokenize(files, limit, end_id)), _PIECES_DDL), "pieces")
    by_part = scratch.save(pieces.groupBy("part", "length").count(), "by_part")
    counts = np.zeros(limit + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most ``limit`` rows
        counts[row["length"]] = row["n"]
    where = placements(plan_bins(counts, limit), limit)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("rank"))
    return ranked.mapInArrow(lean(_place(where)), _PLACED_DDL)


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
