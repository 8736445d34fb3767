"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Words are hashed in numpy over the bytes of many texts at once; the hash of an n-gram rolls over the
hashes of its words. A window is a duplicate if an equal one starts earlier in its text; the words of
duplicate windows are covered, and the rules compare the covered characters with all characters in words.
Equality is that of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import emit, lean, mix, prefix_hash, span_hash, steps, table, utf8, word_spans

#: n-gram length in words -> largest share of the characters in words that later copies may cover.
NGRAM_LIMITS = {5: 0.25, 7: 0.22, 10: 0.20}
#: The same for lines that repeat an earlier one, as a share of characters in words.
LINE_LIMIT = 0.20
#: Largest number of symbols a word.
SYMBOL_LIMIT = 0.1
MIN_WORDS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[f"dup_{n}gram_chars" for n in NGRAM_LIMITS], "dup_line_chars"]
_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in _COLUMNS], ("base_failed", pa.bool_()), ("kept", pa.bool_())])
_DDL = ", ".join(["doc_id long", *[f"{c} long" for c in _COLUMNS], "base_failed boolean", "kept boolean"])
_ODD = np.uint64(0x100000001B3)


def _copies(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys in text order: which equal an earlier one of their text, and which any other one."""
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(key) > 1:
        own = mix(key ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        later[order[1:]] = same
        any_[order[1:]] |= same
        any_[order[:-1]] |= same
    return later, any_


def _covered(hit: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words are in a window of n words that starts where ``hit`` is set."""
    edge = np.zeros(words + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of ``_COLUMNS`` for each of the texts whose bytes are ``raw[at[i]:at[i + 1]]``."""
    n = len(at) - 1
    s, e, doc = word_spans(raw, at)
    total = lambda of, value=None: np.bincount(of, value, n).astype(np.int64)
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    chars = points[e] - points[s]
    prefix = prefix_hash(raw)
    words = span_hash(prefix, s, e)
    out = {"n_words": total(doc), "word_chars": total(doc, chars)}
    out["n_symbols"] = total(np.searchsorted(at, np.flatnonzero(_SYMBOL[raw]), "right") - 1)

    breaks = np.flatnonzero(raw == 0x0A)
    line_s = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    line_e = np.sort(np.concatenate([at[1:], breaks]), kind="stable")
    line_of = np.sort(np.concatenate([np.arange(n), np.searchsorted(at, breaks, "right") - 1]), kind="stable")
    first, last = np.searchsorted(s, line_s), np.searchsorted(s, line_e)
    full = last > first
    line_s, line_e, line_of, first, last = line_s[full], line_e[full], line_of[full], first[full], last[full]
    later, _ = _copies(line_of, span_hash(prefix, line_s, line_e))
    out["n_dup_lines"] = total(line_of[later])
    upto = np.concatenate([[0], np.cumsum(chars)])
    out["dup_line_chars"] = total(line_of[later], (upto[last] - upto[first])[later])

    def windows(k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = words[: max(0, len(words) - k + 1)].copy()
            for i in range(1, k):
                h = h * _ODD + words[i : len(words) - k + 1 + i]
        return h

    for k in (3, *NGRAM_LIMITS):
        inside = doc[: max(0, len(doc) - k + 1)] == doc[k - 1 :]
        at_word = np.flatnonzero(inside)
        later, any_ = _copies(doc[at_word], windows(k)[at_word])
        hit = np.zeros(len(words), bool)
        if k == 3:
            hit[at_word[any_]] = True
            out["n_repeat_words"] = total(doc[_covered(hit, k, len(words))])
        if k in NGRAM_LIMITS:
            hit[:] = False
            hit[at_word[later]] = True
            cover = _covered(hit, k, len(words))
            out[f"dup_{k}gram_chars"] = total(doc[cover], chars[cover])
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    bad = failed | (m["n_symbols"] > SYMBOL_LIMIT * m["n_words"]) | (m["dup_line_chars"] > LINE_LIMIT * m["word_chars"])
    for k, most in NGRAM_LIMITS.items():
        bad = bad | (m[f"dup_{k}gram_chars"] > most * m["word_chars"])
    return failed, ~bad


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = utf8(batch.column(1))
        for lo, hi in steps(at):
            m = measure(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            yield emit(_SCHEMA, [batch.column(0).slice(lo, hi - lo), *[m[c] for c in _COLUMNS], *verdict(m)])


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of ``docs``.

    A null or empty text has no words: all measures are 0, and it is rejected. A long one is measured whole. Of equal
    windows or lines the first in the text is the original. A null doc_id stays null, repeated rows are each measured, and
    other columns are not looked at. No rows, no result.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_rules), _DDL)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are.

    Null and empty texts go, long ones are measured whole; every row is judged by itself, so repeated ones are kept or go
    alike, whatever their doc_id is. No rows, no result.
    """
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_text = names.index("text")
        for batch in batches:
            raw, at = utf8(batch.column(at_text))
            kept = [verdict(measure(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]))[1] for lo, hi in steps(at)]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return docs.mapInArrow(lean(run), schema)


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents"))


def _ngram_sql(k: int, later: bool) -> str:
    hit = "row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1" if later else "count(*) OVER (PARTITION BY doc_id, g) > 1"
    gram = ", ".join(f"lead(w, {j}) OVER x" for j in range(k))
    return f"""
g{k} AS (SELECT doc_id, i, {hit} AS hit FROM (
    SELECT doc_id, i, n, [{gram}] AS g FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM w) WINDOW x AS (PARTITION BY doc_id ORDER BY i)) WHERE i + {k} - 1 <= n),
c{k} AS (SELECT w.doc_id, w.c, max(coalesce(g{k}.hit, false)) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS hit
    FROM w LEFT JOIN g{k} ON w.doc_id = g{k}.doc_id AND w.i = g{k}.i),
s{k} AS (SELECT doc_id, count(*) AS n, sum(c) AS c FROM c{k} WHERE hit GROUP BY doc_id)"""


#: The measures and the verdict over a relation ``docs``.
RULES_SQL = f"""
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, length(unnest(ws)) AS c FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM docs)),
lines AS (SELECT doc_id, l, i, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) AS k, list_sum(list_transform(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+'), lambda x: length(x))) AS c
    FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM docs)) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) AS n, sum(c) AS c FROM lines WHERE k > 1 GROUP BY doc_id),
all_words AS (SELECT doc_id, count(*) AS n, sum(c) AS c FROM w GROUP BY doc_id),
{_ngram_sql(3, False)}, {", ".join(_ngram_sql(k, True) for k in NGRAM_LIMITS)},
measures AS (SELECT d.doc_id, CAST(coalesce(a.n, 0) AS BIGINT) AS n_words, CAST(coalesce(a.c, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(s3.n, 0) AS BIGINT) AS n_repeat_words, {", ".join(f"CAST(coalesce(s{k}.c, 0) AS BIGINT) AS dup_{k}gram_chars" for k in NGRAM_LIMITS)}, CAST(coalesce(dup.c, 0) AS BIGINT) AS dup_line_chars
    FROM docs d LEFT JOIN all_words a USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN s3 USING (doc_id) {" ".join(f"LEFT JOIN s{k} USING (doc_id)" for k in NGRAM_LIMITS)}),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measures),
ruled AS (SELECT *, NOT (base_failed OR n_symbols > {SYMBOL_LIMIT}::DOUBLE * n_words OR dup_line_chars > {LINE_LIMIT}::DOUBLE * word_chars
    {" ".join(f"OR dup_{k}gram_chars > {v}::DOUBLE * word_chars" for k, v in NGRAM_LIMITS.items())}) AS kept FROM judged)
"""
SQL = f"WITH docs AS (SELECT doc_id, text FROM documents), {RULES_SQL} SELECT * FROM ruled"
