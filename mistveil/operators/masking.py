"""Masking by longest match, highlighting, the context rule, restoring and inspecting tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.chars import KANJI, WS, nfc, trim
from ..functions.lexicon import AMBIGUOUS_SET, COMMON_WORDS, canonical_name
from .names import _LABELS
from .spans import CLOSE, OPEN, occurrences

# In the row, as Columns -----------------------------------------------------------------


def active(entries: Column) -> Column:
    """Entries that mask: enabled, approved and not empty."""
    return F.filter(entries, lambda e: e["enabled"] & (e["review_status"] == "approved") & (F.length(e["normalized_text"]) > 0))


def _longest_first(entries: Column) -> Column:
    return F.array_sort(entries, lambda a, b: F.when(F.length(a["text"]) != F.length(b["text"]), F.length(b["text"]) - F.length(a["text"])).when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0))


def mask(text: Column, pairs: Column) -> Column:
    """``text`` with every value of ``pairs`` (array of (text, token)) replaced, in one scan from the left, the longest first.

    What has been replaced is not looked at again. The alternation of values is a pattern of the row.
    """
    ordered = _longest_first(pairs)
    pattern = F.array_join(F.transform(ordered, lambda e: F.concat(F.lit("\\Q"), F.replace(e["text"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), "|")
    table = F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["text"], e["token"])))

    # The marks are two characters that the text does not have; nearly always the first two.
    marks = F.lit(_MARKS[-1])
    for two in reversed(_MARKS[:-1]):
        marks = F.when(~text.rlike(f"[{two}]"), two).otherwise(marks)
    replaced = F.regexp_replace(text, pattern, F.concat(F.left(marks, F.lit(1)), F.lit("$0"), F.right(marks, F.lit(1))))
    pieces = F.split(replaced, F.concat(F.lit("["), marks, F.lit("]")), F.lit(-1))
    masked = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.element_at(table, p)).otherwise(p)), "")
    return F.when(F.size(pairs) > 0, masked).otherwise(text)


_MARKS = (OPEN + CLOSE, "\ufdd0\ufdd1", "\uf8fe\uf8ff")  # private characters, two that are none, the last of the private ones


def restore(response: Column, pairs: Column) -> Column:
    """Tokens replaced by (token, text) of ``pairs``, the longest token first; a restored text may hold a later token."""
    ordered = F.array_sort(pairs, lambda a, b: F.when(F.length(a["token"]) != F.length(b["token"]), F.length(b["token"]) - F.length(a["token"])).when(a["token"] < b["token"], -1).otherwise(1))
    return F.aggregate(ordered, response, lambda acc, e: F.replace(acc, e["token"], e["text"]))


TOKEN = r"\[[^\[\]\s　]+_[0-9]+\]"


def tokens_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def inspect(response: Column, tokens: Column, values: Column, reference: Column) -> Column:
    """known_present, absent and unknown tokens; natural: values that the response has more often than the reference."""
    found = tokens_in(response)
    return F.struct(
        F.array_intersect(tokens, found).alias("known_present"),
        F.array_except(tokens, found).alias("absent"),
        F.array_except(found, tokens).alias("unknown"),
        F.filter(F.array_distinct(values), lambda v: occurrences(response, v) > occurrences(reference, v)).alias("natural"),
    )


# The context rule, over one text ---------------------------------------------------------

# What shows before or behind a surname that it is one.
_LABEL_BEFORE = re.compile(f"(?:{_LABELS})[{WS}]*(?:[:：=]|は|が)?[{WS}]*\\Z")
_TITLE_AFTER = re.compile("(?:さん|様|殿|氏|先生|君|くん|ちゃん|相談役|顧問|会長|社長|副社長|専務|常務|監査役|執行役員|理事長?|本部長|事業部長|部長(?:代理)?|次長|室長|課長|参事|主幹|係長|主任|チーフ|リーダー|マネージャー)")
_GIVEN_AFTER = re.compile(f"[ 　\\r\\n]+[{KANJI}]{{1,4}}(?=\\Z|[{WS}、。，,.！？!?「」『』（）()【】])")
_ITEM_BEFORE = re.compile("(?:^|\\r?\\n)[ 　]*(?:[-*・]|[0-9０-９]+[.)．、])[ 　]*\\Z")


def is_contextual(entry: dict, mode: str = "contextual") -> bool:
    return mode == "contextual" and entry["category"] == "PERSON" and "manual" not in entry["sources"] and canonical_name(entry["original_text"]) in AMBIGUOUS_SET


def decide(text: str, entry: dict, start: int, end: int, mode: str = "contextual") -> bool:
    """Whether an occurrence is masked: a one-character surname is not where it is part of a common word, unless context or a model says so."""
    if not is_contextual(entry, mode) or "ner" in entry["sources"]:
        return True
    line, after = text[text.rfind("\n", 0, start) + 1 : start], text[end : end + 8]
    if _LABEL_BEFORE.search(line) or _TITLE_AFTER.match(after) or _GIVEN_AFTER.match(after) or _ITEM_BEFORE.search(line):
        return True
    name = canonical_name(entry["original_text"])
    for phrase in COMMON_WORDS.get(name, ()):
        at = start - phrase.find(name)
        if at >= 0 and text[at : at + len(phrase)] == phrase:
            return False
    return True


def maskable_count(text: str, entry: dict, mode: str = "contextual") -> int:
    text, value = nfc(text), nfc(entry["original_text"])
    n, i = 0, text.find(value) if value else -1
    while i >= 0:
        n += decide(text, entry, i, i + len(value), mode)
        i = text.find(value, i + len(value))
    return n


def segments(text: str, entries: list[dict], mode: str = "contextual", everything: bool = False) -> list[dict]:
    """Runs of text and of entries, from the left, the longest entry first. ``everything``: disabled entries too, for highlighting."""
    text = nfc(text)
    own = [e for e in entries if e["normalized_text"] and (everything or e["enabled"] and e["review_status"] == "approved")]
    by = {}
    for e in sorted(own, key=lambda e: (-len(e["normalized_text"]), e["token"])):
        by.setdefault(e["normalized_text"], e)
    if not by:
        return [{"type": "text", "value": text, "start": 0, "end": len(text), "token": None}] if text else []
    pattern = re.compile("|".join(map(re.escape, by)))
    out, at, i = [], 0, 0

    def plain(a: int, b: int) -> None:
        if b > a:
            out.append({"type": "text", "value": text[a:b], "start": a, "end": b, "token": None})

    while m := pattern.search(text, i):
        a, b = m.span()
        e = by[m[0]]
        if not everything and not decide(text, e, a, b, mode):
            rest = [v for v in by if len(v) < len(m[0]) and text.startswith(v, a) and decide(text, by[v], a, a + len(v), mode)]
            if not rest:
                i = a + 1
                continue
            e, b = by[rest[0]], a + len(rest[0])
        plain(at, a)
        out.append({"type": "entry", "value": text[a:b], "start": a, "end": b, "token": e["token"], "enabled": e["enabled"], "review_status": e["review_status"]})
        at = i = b
    plain(at, len(text))
    return out


def mask_text(text: str, entries: list[dict], mode: str = "contextual") -> str:
    return "".join(s["token"] or s["value"] for s in segments(text, entries, mode))


def restore_text(response: str, entries: list[dict]) -> str:
    for e in sorted((e for e in entries if e["enabled"] and e["review_status"] == "approved"), key=lambda e: (-len(e["token"]), e["token"])):
        response = response.replace(e["token"], e["restoration_text"])
    return response


def inspect_text(response: str, entries: list[dict], reference: str) -> dict:
    own = [e for e in entries if e["enabled"] and e["review_status"] == "approved"]
    known = list(dict.fromkeys(e["token"] for e in own))
    found = list(dict.fromkeys(re.findall(TOKEN, response)))
    values = list(dict.fromkeys(e["normalized_text"] for e in own))
    return {
        "known_present": [t for t in known if t in found],
        "absent": [t for t in known if t not in found],
        "unknown": [t for t in found if t not in known],
        "natural": [v for v in values if trim(v) and response.count(v) > reference.count(v)],
    }
