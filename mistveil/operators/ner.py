"""Chunking for a token classifier, and candidates from its outputs. The classifier is the caller's."""

from __future__ import annotations

import re
import threading
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chars import KANJI, trim
from ..functions.lexicon import AMBIGUOUS_SET, canonical_name, surnames
from .addresses import ADDRESS_LABEL
from .candidates import Candidate, ranges_of, replace
from .masking import _GIVEN_AFTER, _ITEM_BEFORE, _LABEL_BEFORE, _TITLE_AFTER
from .normalize import back, normalize
from .pipeline import ENTRY_DDL, detect, enrich, extend_titles, merge, once, refine

CHUNK, OVERLAP = 320, 64
# The labels of models and the categories that they stand for.
LABELS = {"PER": "PERSON", "PERSON": "PERSON", "ORG": "ORGANIZATION", "ORG-P": "ORGANIZATION", "ORG-O": "ORGANIZATION", "ORGANIZATION": "ORGANIZATION", "LOC": "ADDRESS", "LOCATION": "ADDRESS", "INS": "ADDRESS", "人名": "PERSON", "法人名": "ORGANIZATION", "政治的組織名": "ORGANIZATION", "その他の組織名": "ORGANIZATION", "その他の組織": "ORGANIZATION", "地名": "ADDRESS", "施設名": "ADDRESS"}
Classifier = Callable[[str], list[dict]]


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Windows that cover the text; each ends behind the last line or sentence end in its final 40 %, if there is one.

    Sizes are UTF-16 units and offsets code points; no window begins or ends inside a character.
    """
    if not isinstance(size, int) or size < 2 or not isinstance(overlap, int) or not 0 <= overlap < size:
        raise ValueError("size is a whole number from 2, overlap one from 0 that is smaller")
    units = None if text.isascii() or max(text) < "\U00010000" else [0, *accumulate(1 + (c > "\uffff") for c in text)]
    unit = (lambda i: i) if units is None else units.__getitem__
    char = (lambda u: u) if units is None else (lambda u: bisect_right(units, u) - 1)  # down to a whole character
    out, start, last = [], 0, unit(len(text))
    while start < len(text):
        end = char(min(last, unit(start) + size))
        if end < len(text):
            least = unit(start) + ceil(size * 0.6)
            cut = max(text.rfind(c, start, end) for c in "\n。！？!?") + 1
            end = cut if cut and unit(cut) >= least else end
        out.append((start, end, text[start:end]))
        if end >= len(text):
            break
        start = max(start + 1, char(unit(end) - overlap))
    return out


def label(name: str | None) -> str | None:
    return LABELS.get(re.sub("^[BI]-", "", name or "").upper())


def clean(word: str | None) -> str:
    return trim(re.sub("^▁", "", word or "").replace("##", ""))


def from_outputs(text: str, outputs: list[dict], known: list[Candidate] = ()) -> list[Candidate]:
    """Candidates of one chunk: labels mapped, texts checked, fragments and weak ones dropped."""
    out: dict[tuple, Candidate] = {}
    for o in outputs:
        category = label(o.get("entity_group") or o.get("entity"))
        a, b = o.get("start"), o.get("end")
        placed = a is not None and b is not None and 0 <= a < b <= len(text)
        value = trim(text[a:b]) if placed else clean(o.get("word"))
        if not category or not value or value not in text:
            continue
        if placed:
            a = text.find(value, a)
        else:
            places = ranges_of(text, value)
            a = places[0][0] if len(places) == 1 else None
        c = Candidate(value, category, "ner", a, a + len(value) if a is not None else None, confidence=o.get("score"))
        if not _weak(text, c, known):
            out.setdefault(c.key, c)
    return list(out.values())


def _weak(text: str, c: Candidate, known: list[Candidate]) -> bool:
    name, places = canonical_name(c.text), [c.span] if c.span else ranges_of(text, c.text)
    if c.category == "PERSON" and name in AMBIGUOUS_SET:
        return not any(_person_context(text, a, b) for a, b in places)
    if len(c.text) <= 1 or re.fullmatch("[A-Za-z0-9]{1,3}", c.text):
        return True
    if any(c.text != k.text and c.text in k.text for k in known):
        return True
    if re.fullmatch(f"[{KANJI}]{{2}}", c.text) and c.category == "PERSON":
        joined = re.compile(f"[{KANJI}]")
        if not any(not joined.match(text[a - 1 : a] if a else "") and not joined.match(text[b : b + 1]) for a, b in places):
            return True
    if c.category == "ADDRESS" and name in {canonical_name(x) for x in surnames()}:
        return not any(re.search(ADDRESS_LABEL, text[max(0, a - 16) : a]) for a, _ in places)
    return False


def _person_context(text: str, a: int, b: int) -> bool:
    line = text[text.rfind("\n", 0, a) + 1 : a]
    return bool(_LABEL_BEFORE.search(line) or _TITLE_AFTER.match(text, b) or _GIVEN_AFTER.match(text, b) or _ITEM_BEFORE.search(line))


def _best(candidates: list[Candidate]) -> list[Candidate]:
    """Equal candidates as one, with the highest confidence and all rules."""
    out: dict[tuple, Candidate] = {}
    for c in candidates:
        was = out.get(c.key)
        if was:
            best = max((x for x in (was.confidence, c.confidence) if x is not None), default=None)
            c = replace(was, confidence=best, rules=tuple(dict.fromkeys(was.rules + c.rules)))
        out[c.key] = c
    return list(out.values())


def run_chunked(text: str, classify: Classifier, known: list[Candidate] = ()) -> list[Candidate]:
    out = []
    for start, _, part in chunks(text):
        for c in from_outputs(part, classify(part), known):
            out.append(c if c.start is None else replace(c, start=c.start + start, end=c.end + start))
    return _best(out)


def run_normalized(text: str, classify: Classifier, known: list[Candidate] = ()) -> list[Candidate]:
    """Over the text with spaced and broken names joined; each candidate stands for all its occurrences there."""
    m = normalize(text, ("japanese_inter_character_space", "person_name_line_break", "organization_line_break"))
    out = []
    for c in run_chunked(m.text, classify, known):
        for a, b in ranges_of(m.text, c.text):
            own = replace(c, start=a, end=b)
            span = m.to_source(a, b)
            out += back(m, [own]) or ([replace(own, start=span[0], end=span[1])] if span else [])
    return _best(out)


class ClassifierTimeout(TimeoutError):
    pass


def limited(classify: Classifier, seconds: float) -> Classifier:
    """The classifier, each call of which has to end within some seconds."""

    def run(text: str) -> list[dict]:
        done: list = []

        def call() -> None:
            try:
                done.append((classify(text), None))
            except BaseException as e:  # handed on to the caller
                done.append((None, e))

        thread = threading.Thread(target=call, daemon=True)
        thread.start()
        thread.join(seconds)
        if not done:
            raise ClassifierTimeout(f"no answer within {seconds} s")
        if done[0][1] is not None:
            raise done[0][1]
        return done[0][0]

    return run


def with_entries(docs: DataFrame, load: Callable[[], Classifier], seconds: float = 300) -> DataFrame:
    """``docs`` with entries from the detectors and a model.

    ``load`` is called once a task, on the executor; if it fails, or an answer takes longer than ``seconds``, the task is tried again.
    Chunks of a document are classified one after the other, and documents in parallel.
    """

    @F.pandas_udf(ENTRY_DDL)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classify = limited(load(), seconds)

        def entries(text: str | None) -> list[dict]:
            text = text or ""
            found = detect(text)
            return merge(text, [], extend_titles(text, refine(text, enrich(text, found + run_normalized(text, classify, [c for c in found if c.category not in ("PERSON", "ORGANIZATION")])))))

        for texts in batches:
            yield texts.map(entries)

    return docs.withColumn("entries", once(run)("text"))


__all__ = ["chunks", "clean", "from_outputs", "label", "run_chunked", "run_normalized", "with_entries"]
