"""Candidate spans of one text: the record, and helpers over lists of them."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, replace
from itertools import accumulate

from ..functions.chars import trim, trim_edges


@dataclass(frozen=True)
class Candidate:
    text: str
    category: str
    source: str = "regex"
    start: int | None = None
    end: int | None = None
    restoration: str | None = None
    confidence: float | None = None
    rules: tuple[str, ...] = ()

    @property
    def key(self) -> tuple:
        return self.category, self.text, self.start, self.end

    @property
    def span(self) -> tuple[int, int] | None:
        """The range, if there is a valid one."""
        if self.start is None or self.end is None or self.start < 0 or self.end <= self.start:
            return None
        return self.start, self.end


def at(text: str, start: int, end: int, category: str, trimmed: bool = True) -> list[Candidate]:
    """The candidate at a range, without what is trimmed at its edges; none if that leaves a blank."""
    if trimmed:
        start, end = trim_edges(text, start, end)
    value = text[start:end]
    return [Candidate(value, category, start=start, end=end)] if trim(value) else []


def unique(candidates: list[Candidate]) -> list[Candidate]:
    seen: dict[tuple, Candidate] = {}
    for c in candidates:
        seen.setdefault(c.key, c)
    return list(seen.values())


def inside(c: Candidate, others: list[Candidate]) -> bool:
    if c.start is None or c.end is None:
        return False
    return any(o.start is not None and o.end is not None and o.start <= c.start and c.end <= o.end for o in others)


def strictly_inside(c: Candidate, o: Candidate) -> bool:
    a, b = c.span, o.span
    return bool(a and b and b[0] <= a[0] and a[1] <= b[1] and a != b)


def ranges_of(text: str, value: str) -> list[tuple[int, int]]:
    """Non-overlapping occurrences from the left; none of an empty value."""
    out = []
    i = text.find(value) if value else -1
    while i >= 0:
        out.append((i, i + len(value)))
        i = text.find(value, i + len(value))
    return out


class Cover:
    """Ranges, of which ``in`` tells whether one of them holds a range, by binary search."""

    def __init__(self, ranges):
        own = sorted(ranges)
        self.starts = [a for a, _ in own]
        self.ends = list(accumulate((b for _, b in own), max))  # the largest end so far

    def __contains__(self, r: tuple[int, int]) -> bool:
        i = bisect_right(self.starts, r[0])
        return i > 0 and self.ends[i - 1] >= r[1]


__all__ = ["Candidate", "Cover", "at", "inside", "ranges_of", "replace", "strictly_inside", "unique"]
