"""Spans in built-in expressions: where a pattern matches, as an array of structs in the document's row.

A pattern with two groups (what comes before, the value) is marked with two private-use characters by
``regexp_replace`` and the text split at them; running lengths give exact offsets in code points. No UDF, no
shuffle, and look-ahead works as written. Marks that the source itself contains are replaced before.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.chars import EDGE

OPEN, CLOSE = chr(0xE000), chr(0xE001)
_BLANK = chr(0xFFFD)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of group 2 of each match, in order; group 1 is what comes before it."""
    safe = F.translate(text, OPEN + CLOSE, _BLANK * 2)
    pieces = F.split(F.regexp_replace(safe, pattern, f"$1{OPEN}$2{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        found = F.when(acc["inside"], F.array_append(acc["out"], F.struct(acc["at"].alias("start"), end.alias("end")))).otherwise(acc["out"])
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), found.alias("out"))

    found = F.aggregate(pieces, start, step)["out"]
    whole = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("text")))
    return F.coalesce(whole, F.array().cast("array<struct<start:int,end:int,text:string>>"))


_EDGES = "".join("\\" + c if c in "\\]^-[" else c for c in EDGE)


def trim_spans(column: Column) -> Column:
    """Spans without the quotes, brackets, punctuation and spaces at their edges; blank ones go."""

    def one(x: Column) -> Column:
        left = F.regexp_replace(x["text"], f"^[{_EDGES}]+", "")
        inner = F.regexp_replace(left, f"[{_EDGES}]+\\z", "")
        at = x["start"] + F.length(x["text"]) - F.length(left)
        return F.struct(at.alias("start"), (at + F.length(inner)).alias("end"), inner.alias("text"))

    return F.filter(F.transform(column, one), lambda x: F.length(x["text"]) > 0)


def contained(inner: Column, outers: Column) -> Column:
    """Whether a span lies in any of an array of spans."""
    return F.exists(outers, lambda o: (o["start"] <= inner["start"]) & (inner["end"] <= o["end"]))


def outside(inners: Column, outers: Column) -> Column:
    """The spans that lie in none of the others: an interval anti-join inside the row."""
    return F.filter(inners, lambda x: ~contained(x, outers))


def strictly_contained(inner: Column, outers: Column) -> Column:
    return F.exists(outers, lambda o: (o["start"] <= inner["start"]) & (inner["end"] <= o["end"]) & ((o["start"] < inner["start"]) | (inner["end"] < o["end"])))


def tagged(column: Column, category: str) -> Column:
    return F.transform(column, lambda x: F.struct(F.lit(category).alias("category"), x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end")))


def occurrences(text: Column, value: Column) -> Column:
    """Number of non-overlapping occurrences; 0 for an empty value."""
    return F.when(F.length(value) > 0, ((F.length(text) - F.length(F.replace(text, value))) / F.length(value)).cast("int")).otherwise(0)
