"""Chat formatting by minimum-cost role repair.

A conversation is legal if it is an optional system message, then user and assistant in turn, ending with the
assistant. Dynamic programming over the automaton of these rules chooses for each turn its role (a relabel costs
``RELABEL``), whether it is merged into the message before, of the same role (``MERGE``), and which empty
messages come before it (``INSERT`` each), at the smallest sum. Turns are then rendered one by one, so that the
pieces of a conversation, one after the other, are its text.

Conversations are dealt by ranges of (conv_id, turn, role, text), so a long one spans several partitions. A
stretch of turns acts on the automaton's states as a (min, +) matrix. The matrices of the first and last
conversation of each partition, two small rows a partition, tell in which state each stretch begins and ends on
the best path, and each partition then decodes its own turns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, Scratch, table

RELABEL, MERGE, INSERT = 2.0, 0.6, 0.9
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
_LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _fillers() -> dict[tuple[int, int], tuple[int, ...] | None]:
    """The shortest legal messages between two states, None where there are none."""
    out: dict = {}
    for a in range(4):
        paths, seen = [(a, ())], {a}
        out[a, a] = None
        for last, path in paths:
            for b in _LEGAL[last]:
                if (a, b) not in out or out[a, b] is None:
                    out[a, b] = path
                if b not in seen:
                    seen.add(b)
                    paths.append((b, (*path, b)))
        for b in range(4):
            out.setdefault((a, b), None)
    return out


FILL = _fillers()
#: What ends a conversation in each state.
CLOSE = {START: None, SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
#: The ways from state a to b with one turn: (extra cost, merged, messages inserted before it).
WAYS: dict[tuple[int, int], list] = {(a, b): [] for a in range(4) for b in range(4)}
for (_a, _b), _fill in FILL.items():
    if _fill is not None and _b != START:
        WAYS[_a, _b].append((INSERT * len(_fill), False, _fill))
    if _a == _b != START:
        WAYS[_a, _b].append((MERGE, True, ()))
for _w in WAYS.values():
    _w.sort()


def _costs(role: int) -> np.ndarray:
    out = np.full((4, 4), np.inf)
    for (a, b), ways in WAYS.items():
        if ways:
            out[a, b] = ways[0][0] + (0 if role == b else RELABEL)
    return out


#: By role: 0 for any unknown one.
STEP = np.stack([_costs(r) for r in range(4)])
END = np.array([np.inf, 2 * INSERT, INSERT, 0.0])


def product(roles: np.ndarray) -> np.ndarray:
    """The (min, +) matrix of a stretch of turns."""
    out = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for r in roles:
        out = (out[:, :, None] + STEP[r][None]).min(axis=1)
    return out


def decode(roles: np.ndarray, first: int, last: int | None) -> list[int]:
    """The states after each turn on the best path from ``first`` to ``last`` (None: any, then closed)."""
    value = np.full(4, np.inf)
    value[first] = 0
    back = []
    for r in roles:
        via = value[:, None] + STEP[r]
        back.append(via.argmin(axis=0))
        value = via.min(axis=0)
    state = int((value + END).argmin()) if last is None else last
    out = []
    for b in reversed(back):
        out.append(state)
        state = int(b[state])
    return out[::-1]


def _message(role: int, text: str) -> str:
    return f"<|im_start|>{ROLES[role - 1]}\n{text}"


_STOP = "<|im_end|>\n"


def escape(text: str) -> str:
    """Text that cannot be taken for a marker."""
    return text.replace("<|im_", "<\\|im_")


def render(states: list[int], first: int, texts: list[str], closes: bool, opened: bool) -> list[tuple[bool, int, str]]:
    """For each turn: merged, messages inserted before it, and its piece; the last one closes the conversation."""
    out = []
    state = first
    for k, (s, text) in enumerate(zip(states, texts)):
        _, merged, fill = WAYS[state, s][0]
        piece = "\n\n" + text if merged else (_STOP if opened else "") + "".join(_message(f, "") + _STOP for f in fill) + _message(s, text)
        opened = True
        state = s
        if closes and k == len(states) - 1:
            piece += _STOP + "".join(_message(f, "") + _STOP for f in CLOSE[s])
        out.append((merged, len(fill), piece))
    return out


_ROWS = "part int, at long, conv_id long, turn long, role string, text string"
_ENDS = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()), ("matrix", pa.binary())])
_OUT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("merged", pa.bool_()), ("n_inserted", pa.int32()), ("rendered", pa.string())])
_OUT_DDL = "conv_id long, turn long, seq long, role string, new_role string, merged boolean, n_inserted int, rendered string"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(at, at + n), pa.int64()), *batch.columns], names=["part", "at", *batch.schema.names])
        at += n


def _role(name: str | None) -> int:
    name = (name or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else 0


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int | None, list]]:
    """(part, first place, conv_id, rows) of consecutive rows of one conversation in one partition."""
    key, first, rows = None, 0, []
    for batch in batches:
        for part, at, conv, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (part, conv) and rows:
                yield key[0], first, key[1], rows
                rows = []
            if not rows:
                key, first = (part, conv), at
            rows.append(rest)
    if rows:
        yield key[0], first, key[1], rows


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrices of the first and the last stretch of each partition; rows are (part, at, conv_id, role)."""
    kept: list[tuple] = []
    out = []

    def close() -> None:
        for part, at, conv, rows in [kept[0], kept[-1]][: len(kept)]:
            out.append((part, at, conv, len(rows), product(np.array([_role(r[0]) for r in rows])).tobytes()))

    for x in _stretches(batches):
        if kept and kept[-1][0] != x[0]:
            close()
            kept = []
        kept = [*kept[:1], x]
    if kept:
        close()
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ENDS)] if out else [pa.array([], f.type) for f in _ENDS], schema=_ENDS)


def _path(rows: list) -> dict[tuple[int, int], tuple[int, int | None, int, bool]]:
    """(part, at) -> first state, last state (None: the conversation ends there), turns before, whether one is open."""
    out = {}
    rows = sorted(rows, key=lambda r: (r["part"], r["at"]))
    lo = 0
    while lo < len(rows):
        hi = lo + 1
        while hi < len(rows) and rows[hi]["conv_id"] == rows[lo]["conv_id"]:
            hi += 1
        if hi - lo > 1:
            value, back = np.array([0.0, np.inf, np.inf, np.inf]), []
            for r in rows[lo:hi]:
                via = value[:, None] + np.frombuffer(r["matrix"], np.float64).reshape(4, 4)
                back.append(via.argmin(axis=0))
                value = via.min(axis=0)
            state, before = int((value + END).argmin()), sum(r["n"] for r in rows[lo:hi])
            for k in range(hi - 1, lo - 1, -1):
                first = int(back[k - lo][state])
                before -= rows[k]["n"]
                out[rows[k]["part"], rows[k]["at"]] = (first, state, before, k == hi - 1)
                state = first
        lo = hi
    return out


def repair(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """One row for each turn: conv_id, turn, seq, role, new_role, merged, n_inserted and rendered.

    ``rendered``, in the order of seq, is the conversation. Turns are in the order of turn (nulls last), role and text; repeated
    rows follow each other. A null text is empty, an unknown or null role costs a relabel whatever it becomes.
    Rows without a conv_id are one conversation, of their own. A conversation of nothing has no rows. Long turns and
    conversations are rendered whole, in as many partitions as their rows are in. Of equally cheap repairs one is taken, the
    same each time. Other columns are not looked at. No rows, no result.
    """
    scratch = Scratch(spark, "chat")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(lean(_number), _ROWS)
    dealt = scratch.save(dealt, "dealt")
    placed = dealt.repartition("part").sortWithinPartitions("part", "at")
    ends = placed.select("part", "at", "conv_id", "role").mapInArrow(lean(_ends), "part int, at long, conv_id long, n long, matrix binary")
    path = _path(ends.collect())  # two rows a partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        size = 0
        for part, at, conv, turns in _stretches(batches):
            first, last, before, closes = path.get((part, at), (START, None, 0, True))
            roles = np.array([_role(t[1]) for t in turns])
            states = decode(roles, first, last)
            for k, (t, s, r) in enumerate(zip(turns, states, render(states, first, [escape(t[2]) for t in turns], closes, before > 0))):
                out.append([conv, t[0], before + k, t[1], ROLES[s - 1], r[0], r[1], r[2]])
                size += len(r[2])
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)

    return placed.select("part", "at", "conv_id", "turn", "role", "text").mapInArrow(lean(run), _OUT_DDL)


def op7_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark, table(spark, sf_dir, "conversations"))
