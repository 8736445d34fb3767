"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy step looks at; arrays over them are 8 to 30 times as large.
STEP_BYTES = 1 << 19
#: Limits of an Arrow batch between the JVM and Python, set on the session where they are looser.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Python workers small however long the texts are."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.match(r"\d+", str(spark.conf.get(key)))
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))


class Scratch:
    """Tables written to the folder that driver and executors share.

    The folder is ``spark.checkpoint.dir``. Where that is unset in a local session, as in tests,
    a temporary folder is set; on a cluster that is an error. A written table cuts the lineage and survives a lost executor.
    Tables go with the session, or earlier by ``drop``.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="mistveil-")
            spark.conf.set("spark.checkpoint.dir", base)
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._fs(self.root)[0].deleteOnExit(self._fs(self.root)[1])

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def save(self, df: DataFrame, name: str, large: bool = False) -> DataFrame:
        """``large``: rows of megabytes, of which a writer should not hold a hundred before it looks at the size of a page."""
        path = f"{self.root}/{name}"
        options = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(16 << 20)} if large else {}
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = self._fs(f"{self.root}/{name}")
            fs.delete(path, True)

    def release(self) -> None:
        """Has the driver find the shuffles of tables that are written, so that their files go. Spark drops a shuffle's files
        when the driver's collector finds that nothing refers to it; what ends a query is told to listeners first."""
        for _ in range(2):
            time.sleep(0.3)
            self.spark._jvm.System.gc()


def lean(run):
    """``run`` for mapInArrow, whose worker gives unused memory back at the end of a task; workers live on between tasks."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return own


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after the other, and each text's end points (nulls are empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def steps(at: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``limit`` bytes; a longer text is a range of its own."""
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def emit(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)


# 64-bit hashing in numpy ----------------------------------------------------------------

_U = np.uint64
#: Odd base of the polynomial hash and its inverse modulo 2**64.
BASE = _U(0x9E3779B97F4A7C15)
INVERSE = _U(pow(int(BASE), -1, 1 << 64))
#: One random 64-bit value a byte.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i < n; kept up to a few MB."""
    size = 1 << max(12, (n - 1).bit_length() if n > 1 else 1)
    if size not in _powers:
        with np.errstate(over="ignore"):
            both = []
            for b in (BASE, INVERSE):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
        if size > 1 << 22:
            return tuple(both)
        _powers.clear()
        _powers[size] = tuple(both)
    return _powers[size]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span in constant time."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[raw] * powers(len(raw) + 1)[0][: len(raw)], out=out[1:])
        return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        inverse = powers(len(prefix))[1]
        return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word ``[^\\x20\\x09-\\x0D]+`` and the text it is in; words end with their text."""
    word = ~_WHITE[raw]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    cut = at[1:-1]
    cut = cut[cut < len(raw)]
    starts[cut] = word[cut]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    cut = cut[cut > 0]
    ends[cut - 1] = word[cut - 1]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(at, s, "right") - 1
