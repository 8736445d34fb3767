"""From a text to its candidates: all detectors in their order, and the stages behind them.

The stages look at one document only, so each document is a row and nothing is shuffled. They run over Arrow batches.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chars import DIGITS, KANJI, WS, digits_of, nfc, trim
from ..functions.lexicon import CATEGORY_LABELS, TITLES, split_name, surname_pattern
from ..functions.patterns import PHONE_DIGITS, SHAPES, valid_email
from ..functions.patterns import emails as email_spans
from .candidates import Candidate, Cover, at, inside, ranges_of, replace, strictly_inside, unique
from .names import AFTER_TITLE, addresses, birth_dates, credentials, pattern, person_names, titled_names
from .normalize import broken_organizations, normalized, normalized_addresses, normalized_names

# The structured detectors for text inside the row; the Column forms in ``structured`` are made of the same table.
_SHAPES = {name: shape.python() for name, shape in SHAPES.items()}
_PHONE_OK = re.compile(PHONE_DIGITS)
_HOST = re.compile(r"https?://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def emails(text: str) -> list[Candidate]:
    if "@" not in text:
        return []
    return unique([c for span in email_spans(text) if valid_email(text[slice(*span)]) for c in at(text, *span, "EMAIL")])


def phones(text: str) -> list[Candidate]:
    return unique([c for m in _SHAPES["phone"].finditer(text) if _PHONE_OK.fullmatch(digits_of(m[0])) for c in at(text, *m.span(), "PHONE")])


def postal_codes(text: str) -> list[Candidate]:
    return unique([c for m in _SHAPES["postal"].finditer(text) for c in at(text, *m.span(), "POSTAL_CODE")])


def urls(text: str) -> list[Candidate]:
    out = [c for m in _SHAPES["url"].finditer(text) for c in at(text, *m.span(), "OTHER")]
    return unique([c for c in out if (h := _HOST.match(c.text)) and (h[1].lower() == "localhost" or "." in h[1])])


def _ipv6_ok(v: str) -> bool:
    if ":::" in v or v.startswith(":") and not v.startswith("::") or v.endswith(":") and not v.endswith("::") or v.count("::") > 1:
        return False
    groups = [g for g in v.split(":") if g]
    return all(len(g) <= 4 for g in groups) and (len(groups) < 8 if "::" in v else len(groups) == 8)


def ip_addresses(text: str) -> list[Candidate]:
    four = [m for m in _SHAPES["ipv4"].finditer(text) if all(re.fullmatch("0|[1-9][0-9]{0,2}", p) and int(p) <= 255 for p in m[0].split("."))]
    six = [m for m in _SHAPES["ipv6"].finditer(text) if _ipv6_ok(m[0])] if ":" in text else []
    return unique([Candidate(m[0], "OTHER", start=m.start(), end=m.end()) for m in four + six])


def _prefer(plain: list[Candidate], better: list[Candidate]) -> list[Candidate]:
    """Normalized candidates supersede the plain ones that they contain."""
    return unique(better + [c for c in plain if not inside(c, better)])


def detect(text: str) -> list[Candidate]:
    """All detectors, in the order that decides which of equal candidates wins."""
    email = _prefer(emails(text), normalized(text, ("fullwidth_ascii", "hyphen_variants", "email_line_break", "email_at_spacing"), emails) if re.search("[@＠]", text) else [])
    url = _prefer(urls(text), normalized(text, ("fullwidth_ascii", "hyphen_variants", "url_line_break"), urls) if re.search("[:：]", text) else [])
    phone = _prefer(phones(text), normalized(text, ("fullwidth_ascii", "hyphen_variants", "phone_line_break"), phones) if re.search(f"[{DIGITS}]", text) else [])
    postal = [c for c in postal_codes(text) if not inside(c, phone)]
    ip = [c for c in ip_addresses(text) if not inside(c, url)]
    out = birth_dates(text) + credentials(text) + email + phone + postal + url + ip + broken_organizations(text)
    out += _prefer(addresses(text), normalized_addresses(text)) + titled_names(text) + person_names(text) + normalized_names(text)
    return unique(out)


# Behind the detectors -------------------------------------------------------------------

# What stands beside a surname that stands alone.
_ALONE_BEFORE = re.compile(f"(?:^|[{WS}、。，,.「」『』\"'（）()はがをにへともので])\\Z")
_ALONE_AFTER = re.compile(f"(?:\\Z|[{WS}、。，,.「」『』\"'（）()]+|さん|様|氏|部長|課長|社長|主任|先生|から|として|である|です|が|は|を|に|へ|と|も)")
_SPACED_ON = re.compile(f"[ 　]+[{KANJI}]")
_FENCED_NAME = re.compile(f"```[^\\r\\n]*\\r?\\n[ \\t]*([{KANJI}]{{4,7}})[ \\t]*\\r?\\n```")
_KANJI = re.compile(f"[{KANJI}]\\Z")


def _alone(text: str, a: int, b: int) -> bool:
    return bool(_ALONE_BEFORE.search(text[max(0, a - 1) : a]) and _ALONE_AFTER.match(text, b) and not _SPACED_ON.match(text, b))


def _surnames(candidates: list[Candidate]) -> list[str]:
    return list(dict.fromkeys(s[0] for c in candidates if (s := split_name(c.text))))


def enrich(text: str, candidates: list[Candidate]) -> list[Candidate]:
    """Adds names in fences, spaced spellings of a model's names, names before a reading, and surnames that stand alone."""
    people = [c for c in candidates if c.category == "PERSON"]
    known = Cover(r for value in {c.text for c in people} for r in ranges_of(text, value))
    used_alone = {s for s in _surnames(people) if any(r not in known and _alone(text, *r) for r in ranges_of(text, s))}
    compact = {re.sub("[ 　]+", "", c.text) for c in people}
    fenced = []
    for m in _FENCED_NAME.finditer(text):
        s = split_name(m[1])
        if s and len(s[1]) - len(s[0]) >= 2 and s[0] in used_alone and s[1] not in compact:
            fenced.append(Candidate(m[1], "PERSON", start=m.start(1), end=m.end(1)))
    seen, spaced = {c.key for c in candidates if c.source == "regex"}, []
    for name in dict.fromkeys(c.text for c in people if c.source == "ner" and (s := split_name(c.text)) and s[1] == c.text):
        for m in re.finditer("[ 　]?".join(map(re.escape, name)), text):
            c = Candidate(m[0], "PERSON", start=m.start(), end=m.end(), restoration=name, rules=("japanese_inter_character_space",))
            if re.search("[ 　]", m[0]) and c.key not in seen and not _KANJI.match(text[m.start() - 1 : m.start()] if m.start() else "") and not _KANJI.match(text[m.end() : m.end() + 1]):
                seen.add(c.key)
                spaced.append(c)
    ruby = [Candidate(m[1], "PERSON", start=m.start(1), end=m.end(1)) for m in pattern("ruby").finditer(text) if split_name(m[1])] if surname_pattern() else []
    every = people + unique(fenced) + unique(spaced) + unique(ruby)
    texts = {c.text for c in every}
    full = Cover(r for value in texts for r in ranges_of(text, value))
    alone = [Candidate(s, "PERSON", start=a, end=b) for s in _surnames(every) if len(s) >= 2 and s not in texts for a, b in ranges_of(text, s) if (a, b) not in full and _alone(text, a, b)]
    return candidates + unique(fenced + spaced + ruby + alone)


# Fixed value: an address that is only a floor or room.
_FLOOR = re.compile("[0-9０-９]{1,3}(?:階|号室)\\Z")
_HIRAGANA = re.compile("[ぁ-ゖー]+\\Z")
_READING = re.compile("([ぁ-ゖー]{4,12})(?=[ \\t]*(?:\\Z|\\r?\\n|\\|))")


def refine(text: str, candidates: list[Candidate]) -> list[Candidate]:
    """Drops fragments; every rule looks at the candidates as they came."""
    is_structured = lambda c: c.source == "regex" and (c.category in ("ADDRESS", "EMAIL", "PHONE", "POSTAL_CODE") or c.category == "OTHER" and re.match("https?://", c.text, re.I))
    structured = [c for c in candidates if is_structured(c)]
    phone = [c for c in structured if c.category == "PHONE"]
    mail = Cover(c.span for c in structured if c.category == "EMAIL" and c.span)
    places_of: dict[str, list] = {}

    def occurrences(value: str) -> list[tuple[int, int]]:
        if value not in places_of:
            places_of[value] = ranges_of(text, value)
        return places_of[value]

    readings = [m.span(1) for c in candidates if c.category == "PERSON" and c.span and (m := _READING.match(text, c.end))]

    def drop(c: Candidate) -> bool:
        if c.category == "POSTAL_CODE" and any(strictly_inside(c, p) for p in phone):
            return True
        if c.category == "PERSON" and "@" not in c.text:
            places = occurrences(c.text) if mail.starts else []
            if places and all(r in mail for r in places):
                return True
        if c.source != "ner":
            return False
        if c.span and any(a <= c.start and c.end <= b for a, b in readings):
            return True
        if c.category in ("ADDRESS", "ORGANIZATION"):
            if c.category == "ADDRESS" and _FLOOR.match(c.text):
                return True
            if c.span and _HIRAGANA.match(c.text) and (_HIRAGANA.match(text[c.start - 1 : c.start] if c.start else "") or _HIRAGANA.match(text[c.end : c.end + 1])):
                return True
            longer = Cover(r for value in {o.text for o in candidates if o.category == c.category and len(o.text) > len(c.text)} for r in occurrences(value))
            places = occurrences(c.text)
            if places and longer.starts and all(r in longer for r in places):
                return True
        return c.category != "PERSON" and any(o.text != c.text and strictly_inside(c, o) for o in structured)

    return [c for c in candidates if not drop(c)]


_TITLE = re.compile(f"[ 　\\t]*(?:{TITLES}){AFTER_TITLE}")


def extend_titles(text: str, candidates: list[Candidate]) -> list[Candidate]:
    """People and organizations with the title that follows; unchanged where the place is not certain."""
    out = []
    for c in candidates:
        if c.category in ("PERSON", "ORGANIZATION"):
            span = c.span if c.span and text[slice(*c.span)] == c.text else None
            if not span:
                places = ranges_of(text, c.text)
                span = places[0] if len(places) == 1 else None
            m = _TITLE.match(text, span[1]) if span else None
            if m:
                rest = None if c.restoration is None else c.restoration + m[0]
                c = replace(c, text=text[span[0] : m.end()], start=span[0], end=m.end(), restoration=rest)
        out.append(c)
    return out


def all_candidates(text: str, ner: list[Candidate] = ()) -> list[Candidate]:
    return extend_titles(text, refine(text, enrich(text, detect(text) + list(ner))))


# Entries --------------------------------------------------------------------------------

_PRIORITY = {"regex": 3, "ner": 2, "manual": 1}


def token(category: str, used: set[str], text: str) -> str:
    """The label with the smallest number that no entry has and the text does not contain."""
    n = 1
    while (t := f"[{CATEGORY_LABELS[category]}_{n}]") in used or t in text:
        n += 1
    return t


def merge(text: str, entries: list[dict], candidates: list[Candidate]) -> list[dict]:
    """Entries, one a distinct NFC string, with candidates merged in order. The first category and token of a string stay."""
    text = nfc(text)
    out = [{**e, "sources": list(e["sources"]), "rules": list(e.get("rules") or [])} for e in entries]
    by = {e["normalized_text"]: e for e in out}
    used = {e["token"] for e in out}
    for c in candidates:
        value = nfc(c.text)
        count = text.count(value) if trim(value) else 0
        if not count:
            continue
        if e := by.get(value):
            better = e["restoration_text"] == e["original_text"] or _PRIORITY[c.source] > max(_PRIORITY[s] for s in e["sources"])
            e["confidence"] = max((x for x in (e["confidence"], c.confidence) if x is not None), default=None)
            e["occurrence_count"] = count
            e["rules"] = list(dict.fromkeys([*e["rules"], *c.rules]))
            if c.restoration is not None and better:
                e["restoration_text"] = nfc(c.restoration)
            if c.source not in e["sources"]:
                e["sources"].append(c.source)
            if e["review_status"] == "unreviewed":
                e["review_status"], e["enabled"] = "approved", True
            continue
        e = {"original_text": value, "normalized_text": value, "restoration_text": nfc(c.restoration) if c.restoration is not None else value, "token": token(c.category, used, text), "category": c.category, "sources": [c.source], "confidence": c.confidence, "rules": list(c.rules), "enabled": True, "occurrence_count": count, "review_status": "approved", "display_order": len(out)}
        used.add(e["token"])
        by[value] = e
        out.append(e)
    return out


# Spark ----------------------------------------------------------------------------------

SPAN_DDL = "array<struct<ord:int,category:string,text:string,start:int,end:int,source:string,restoration:string,confidence:double,rules:array<string>>>"
ENTRY_DDL = (
    "array<struct<original_text:string,normalized_text:string,restoration_text:string,token:string,category:string,sources:array<string>,"
    "confidence:double,rules:array<string>,enabled:boolean,occurrence_count:int,review_status:string,display_order:int>>"
)


def rows_of(candidates: list[Candidate]) -> list[dict]:
    return [{"ord": i, "category": c.category, "text": c.text, "start": c.start, "end": c.end, "source": c.source, "restoration": c.restoration, "confidence": c.confidence, "rules": list(c.rules)} for i, c in enumerate(candidates)]


def once(udf):
    """The function, which the optimizer then does not copy into a filter below an ``explode`` (and below a shuffle)."""
    return udf.asNondeterministic()


def with_candidates(docs: DataFrame, stage=all_candidates, column: str = "candidates") -> DataFrame:
    """``docs`` (with text) and an array of candidates in each row; null texts have none."""

    @F.pandas_udf(SPAN_DDL)
    def run(texts):
        return texts.map(lambda t: rows_of(stage(t or "")))

    return docs.withColumn(column, once(run)("text"))


def with_entries(docs: DataFrame) -> DataFrame:
    """``docs`` and the array of its entries: detection, the stages behind it, and the merge by string."""

    @F.pandas_udf(ENTRY_DDL)
    def run(texts):
        return texts.map(lambda t: merge(t or "", [], all_candidates(t or "")))

    return docs.withColumn("entries", once(run)("text"))


def exploded(docs: DataFrame, column: str = "candidates") -> DataFrame:
    return docs.select("doc_id", F.explode(column).alias("c")).select("doc_id", "c.*")


__all__ = ["all_candidates", "detect", "enrich", "exploded", "extend_titles", "merge", "once", "refine", "token", "with_candidates", "with_entries"]
