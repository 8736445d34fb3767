"""Normalization before detection that keeps the way back to the source.

A ``Mapped`` text knows, for each of its characters, the range of the source that it stands for, and the events of the
rules that changed it. Detectors run on the normalized text; what touches an event is mapped back. Rules are applied in
the order given. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

from ..functions.chars import FULLWIDTH, KANJI, fold_fullwidth
from ..functions.lexicon import surname_pattern
from .addresses import scanner
from .candidates import Candidate, replace, unique
from .names import _TOWN, addresses, person_names

# What may be broken over lines or spaced out, and how.
BREAK = "[ 　]*\\r?\\n[ 　]*"
_BREAK = re.compile("(?<![ 　])[ 　]*+\\r?\\n[ 　]*+")  # a run of spaces is looked at from its start only
_OPT = f"(?:{BREAK})?"
_HYPHEN = "−ー―‐–—‑‒"
_LOCAL = "A-Za-z0-9.!#$%&'*+/=?^_`{|}~\\-"
# An address has 254 characters at most; as no part of it is longer, each start costs a bounded time.
_ATOM = "[A-Za-z0-9!#$%&'*+/=?^_`{|}~]{1,254}"
_BEFORE, _AFTER = "(^|[^A-Za-z0-9._%+\\-])", "(?=\\Z|[^A-Za-z0-9._%+\\-])"
_SPACED_EMAIL = re.compile(f"{_BEFORE}([{_LOCAL}]{{1,254}})([ 　]*)@([ 　]*)([A-Za-z0-9-]{{1,254}}(?:\\.[A-Za-z0-9-]{{1,254}}){{1,127}}){_AFTER}")
_LABEL = f"[A-Za-z0-9]{{1,254}}(?:-{_OPT}[A-Za-z0-9]{{1,254}}){{0,127}}"
_BROKEN_EMAILS = (
    re.compile(f"{_BEFORE}([{_LOCAL}]{{1,254}}){_OPT}@{_OPT}({_LABEL}(?:{_OPT}\\.{_OPT}{_LABEL}){{1,127}}){_AFTER}"),
    re.compile(f"{_BEFORE}({_ATOM}(?:{_OPT}[.-]{_OPT}{_ATOM}){{1,127}}){_OPT}@{_OPT}([A-Za-z0-9-]{{1,254}}(?:{_OPT}\\.{_OPT}[A-Za-z0-9-]{{1,254}}){{1,127}}){_AFTER}"),
)
_PH = "\\-‐‑‒–—―－ーｰ"
_PSEP = f"[ 　]*{_OPT}[{_PH}][ 　]*{_OPT}"
_BROKEN_PHONE = re.compile(f"(^|[^0-9０-９A-Za-zＡ-Ｚａ-ｚ{_PH}])([0０][0-9０-９]{{1,4}}{_PSEP}[0-9０-９]{{1,4}}{_PSEP}[0-9０-９]{{3,4}})(?=\\Z|[^0-9０-９A-Za-zＡ-Ｚａ-ｚ{_PH}])")
_URL = "A-Za-z0-9._~:/?@!$&*+,;=%#-"
_URL_CHAR, _URL_TAIL = re.compile(f"[{_URL}]"), re.compile(f"[{_URL}]*")
_URL_HEAD = re.compile(f"(?:^|[^{_URL}])(https?://[{_URL}]*)\\Z", re.I)
_KINDS = "株式会社|有限会社|合同会社|合資会社|合名会社|学校法人|医療法人|社会福祉法人|一般社団法人|一般財団法人"
_ORG = "一-龥々ぁ-ゖァ-ヶーA-Za-z0-9０-９・&＆._"
_BROKEN_ORG = re.compile(f"(^|[^{_ORG}])([{_ORG}]{{2,}}(?:{BREAK}[{_ORG}]{{1,}}){{1,2}})(?=\\Z|[^{_ORG}])")
_ORG_SIGN = re.compile(f"(?:{_KINDS}|会社|法人|協会|組合|銀行|病院|大学|センター|システム|メディカル)")
_ORG_TAIL = re.compile("[ 　]*(?:ですので|でした|である|です|など|等)\\Z")
_HEADING = re.compile("\\s{0,3}#{1,6}(?:\\s|\\Z)")
_FENCE = re.compile("\\s{0,3}(`{3,}|~{3,})")
_FIELD_LINE = re.compile("\\s*(?:氏名|名前|姓|名字|苗字|名義人|担当者?|責任者|患者氏名|申請者)[ 　]*(?:[:：=]|\\Z)")
_LEFT = re.compile(f"(?:^|[ 　:：「『（(])([{KANJI}]{{1,3}})\\Z")
_RIGHT = re.compile(f"([{KANJI}]{{1,3}})(?=\\Z|[^{KANJI}])")
_NAME = "一-龥々ァ-ヶー"
_SPREAD = re.compile(f"(^|[^{_NAME}])((?:[{_NAME}][ 　]){{2,6}}[{_NAME}])(?=\\Z|[^{_NAME}])")
_DEPARTMENT = re.compile("(?:営業|品質|総務|人事|経理|開発|企画|管理|広報|購買|製造|技術|情報システム|サポート)[一-龥々ぁ-ゖァ-ヶー]{0,4}(?:部|課|室|局)\\Z")


@dataclass
class Event:
    rule: str
    start: int
    end: int  # in the source


@dataclass
class Mapped:
    source: str
    text: str
    starts: Sequence[int]
    ends: Sequence[int]
    events: list[Event] = field(default_factory=list)

    @classmethod
    def of(cls, source: str) -> Mapped:
        return cls(source, source, range(len(source)), range(1, len(source) + 1))  # lists only once something is deleted

    def event(self, rule: str, start: int, end: int) -> None:
        self.events.append(Event(rule, self.starts[start], self.ends[end - 1]))

    def delete(self, ranges: list[tuple[int, int]]) -> None:
        if ranges:
            keep = bytearray(b"\1") * len(self.text)
            for a, b in ranges:
                keep[a:b] = bytes(b - a)
            at = [i for i, k in enumerate(keep) if k]
            self.text = "".join(self.text[i] for i in at)
            self.starts, self.ends = [self.starts[i] for i in at], [self.ends[i] for i in at]

    def to_source(self, start: int, end: int) -> tuple[int, int] | None:
        """The source range of a normalized one."""
        if not 0 <= start < end <= len(self.text):
            return None
        return self.starts[start], self.ends[end - 1]

    def touched(self, start: int, end: int) -> list[str]:
        """Distinct rules of the events that overlap a normalized range."""
        found = self.to_source(start, end)
        if not found:
            return []
        return list(dict.fromkeys(e.rule for e in self.events if e.start < found[1] and found[0] < e.end))


def fences(text: str) -> list[tuple[int, int]]:
    """Lines inside Markdown fences, fence lines too; an open one runs to the end."""
    out, marker, at = [], None, 0
    for line in text.splitlines(keepends=True) if "\r" not in text else re.findall("[^\n]*\n|[^\n]+", text):
        m = _FENCE.match(line)
        own = m[1][0] if m else None
        edge = own is not None and marker in (None, own)
        if marker or edge:
            out.append((at, at + len(line)))
        if edge:
            marker = None if marker else own
        at += len(line)
    return out


def _within(ranges: list[tuple[int, int]], i: int) -> bool:
    return any(a <= i < b for a, b in ranges)


def _line(text: str, i: int) -> str:
    end = text.find("\n", i)
    return text[text.rfind("\n", 0, i) + 1 : end if end >= 0 else len(text)]


_FOLDS = {rule: (re.compile("[" + re.escape("".join(map(chr, table))) + "]"), table) for rule, table in {"fullwidth_ascii": {ord(c): fold_fullwidth(c) for c in FULLWIDTH}, "hyphen_variants": {ord(c): "-" for c in _HYPHEN}}.items()}


def _fold(m: Mapped, rule: str) -> None:
    folds, table = _FOLDS[rule]
    found = [x.start() for x in folds.finditer(m.text)]
    for i in found:
        m.event(rule, i, i + 1)
    if found:
        m.text = m.text.translate(table)


def _cut_breaks(m: Mapped, found: list[tuple[int, int]], rule: str) -> None:
    gone = []
    for a, b in dict.fromkeys(found):
        breaks = [(a + x.start(), a + x.end()) for x in _BREAK.finditer(m.text[a:b])]
        gone += breaks
        m.event(rule, a, b)
        if rule == "email_line_break" and any(m.text[a:x].rstrip().endswith("-") for x, _ in breaks):
            m.event("line_end_hyphen", a, b)
    m.delete(gone)


def _at_spacing(m: Mapped) -> None:
    gone = []
    for x in _SPACED_EMAIL.finditer(m.text):
        if x[3] or x[4]:
            gone += [x.span(3), x.span(4)]
            m.event("email_at_spacing", x.start(2), x.end(5))
    m.delete(gone)


def _email_breaks(m: Mapped) -> None:
    _cut_breaks(m, [(x.start(2), x.end()) for p in _BROKEN_EMAILS for x in p.finditer(m.text) if "\n" in x[0][len(x[1]) :]], "email_line_break")


def _phone_breaks(m: Mapped) -> None:
    _cut_breaks(m, [x.span(2) for x in _BROKEN_PHONE.finditer(m.text) if "\n" in x[2]], "phone_line_break")


def _url_breaks(m: Mapped) -> None:
    """One break next to a character of an URL's structure goes at a time, until none is left."""
    at = 0
    while x := _BREAK.search(m.text, at):
        a, b = x.span()
        left, right = m.text[a - 1 : a], m.text[b : b + 1]
        joins = left and right and _URL_CHAR.match(left) and _URL_CHAR.match(right) and (left in "./?&=#-" or right in "./?&=#")
        head = _URL_HEAD.search(m.text[max(0, m.text.rfind("\n", 0, a)) : a]) if joins else None
        if not head:
            at = b
            continue
        start, end = a - len(head[1]), _URL_TAIL.match(m.text, b).end()
        m.event("url_line_break", start, end)
        if left == "-":
            m.event("line_end_hyphen", start, end)
        m.delete([(a, b)])
        at = a


def _organization_breaks(m: Mapped) -> None:
    ranges, found = fences(m.text), []
    for x in _BROKEN_ORG.finditer(m.text):
        value = _ORG_TAIL.sub("", x[2])
        if "\n" not in value:
            continue
        a, b = x.start(2), x.start(2) + len(value)
        parts = [p.strip() for p in re.split("\\r?\\n", value) if p.strip()]
        short = re.fullmatch(_KINDS, parts[0] if parts else "") or any(len(p) <= 3 for p in parts[1:])
        if short and _ORG_SIGN.search(_BREAK.sub("", value)) and not _HEADING.match(_line(m.text, a)) and not _within(ranges, a) and not _within(ranges, b - 1):
            found.append((a, b))
    _cut_breaks(m, found, "organization_line_break")


def _address_breaks(m: Mapped) -> None:
    ranges = fences(m.text)
    found = []
    for a, b in scanner(BREAK).find(m.text):
        if "\n" in m.text[a:b] and not _HEADING.match(_line(m.text, a)) and not _within(ranges, a) and not _within(ranges, b - 1):
            found.append((a, b))
    _cut_breaks(m, found, "address_line_break")


@lru_cache(maxsize=4)
def _spaced_names(names: str) -> tuple[re.Pattern, ...]:
    return (
        re.compile(f"(?:{names})[{KANJI}]{{2,4}}\\Z"),
        re.compile(f"((?:{names})[{KANJI}]{{1,2}})\\Z"),
        re.compile(f"(^|[^{KANJI}])((?:{names})[ 　]?[{KANJI}](?:[ 　]?[{KANJI}])?)(?=\\Z|[^{KANJI}])"),
    )


def _person_breaks(m: Mapped) -> None:
    done, strong, _ = _spaced_names(surname_pattern("all", True))
    ranges, gone = fences(m.text), []
    for x in _BREAK.finditer(m.text):
        a, b = x.span()
        left = m.text[m.text.rfind("\n", 0, a) + 1 : a]
        stop = m.text.find("\n", b)
        right = m.text[b : stop if stop >= 0 else len(m.text)].removesuffix("\r")
        if _within(ranges, a) or _within(ranges, b) or _HEADING.match(left) or _HEADING.match(right) or _FIELD_LINE.match(right):
            continue
        context, name = _LEFT.search(left), strong.search(left)
        after = _RIGHT.match(right)
        if not (context or name) or not after or done.search(left.rstrip()):
            continue
        own = (context or name)[1]
        if not context and not 4 <= len(own) + len(after[1]) <= 5:
            continue
        gone.append((a, b))
        m.event("person_name_line_break", a - len(own), b + len(after[1]))
    m.delete(gone)


def _spread_names(m: Mapped) -> None:
    before, after = re.compile(f"[{_NAME}][ 　\\t]*\\Z"), re.compile(f"[ 　\\t]*[{_NAME}]")
    found = []
    for p in (_SPREAD, _spaced_names(surname_pattern("all", True))[2]):
        for x in p.finditer(m.text):
            a, b = x.span(2)
            if sum(c in " 　" for c in x[2]) >= 2 and not before.search(m.text[max(0, a - 64) : a]) and not after.match(m.text, b):
                found.append((a, b))
    gone = []
    for a, b in dict.fromkeys(found):
        gone += [(i, i + 1) for i in range(a, b) if m.text[i] in " 　"]
        m.event("japanese_inter_character_space", a, b)
    m.delete(gone)


RULES = {
    "fullwidth_ascii": lambda m: _fold(m, "fullwidth_ascii"),
    "hyphen_variants": lambda m: _fold(m, "hyphen_variants"),
    "email_at_spacing": _at_spacing,
    "email_line_break": _email_breaks,
    "url_line_break": _url_breaks,
    "phone_line_break": _phone_breaks,
    "organization_line_break": _organization_breaks,
    "address_line_break": _address_breaks,
    "person_name_line_break": _person_breaks,
    "japanese_inter_character_space": _spread_names,
    "line_end_hyphen": lambda m: None,
}


def normalize(text: str, rules: tuple[str, ...] = ("email_at_spacing",)) -> Mapped:
    m = Mapped.of(text)
    for r in rules:
        RULES[r](m)
    return m


def back(m: Mapped, candidates: list[Candidate]) -> list[Candidate]:
    """Candidates of the normalized text that touch an event, on the source; what they spell there is restored as normalized."""
    out = []
    for c in candidates:
        rules = m.touched(c.start, c.end) if c.span else []
        if rules:
            a, b = m.to_source(c.start, c.end)
            out.append(replace(c, text=m.source[a:b], start=a, end=b, restoration=m.text[c.start : c.end], rules=tuple(rules)))
    return out


def normalized(text: str, rules: tuple[str, ...], detect) -> list[Candidate]:
    m = normalize(text, rules)
    return unique(back(m, detect(m.text))) if m.events else []


_JAPANESE = re.compile("[一-龥々ァ-ヶ]")


def normalized_addresses(text: str) -> list[Candidate]:
    return normalized(text, ("address_line_break",), addresses) if "\n" in text and _TOWN.search(text) else []


def normalized_names(text: str) -> list[Candidate]:
    if not _JAPANESE.search(text):
        return []
    return normalized(text, ("person_name_line_break", "japanese_inter_character_space"), person_names)


def broken_organizations(text: str) -> list[Candidate]:
    """Organizations over a line break, without a department behind them."""
    if "\n" not in text or not _JAPANESE.search(text):
        return []
    m = normalize(text, ("organization_line_break",))
    out = []
    for e in m.events:
        a, b = m.starts.index(e.start), m.ends.index(e.end) + 1
        value = m.text[a:b]
        short = _DEPARTMENT.sub("", value)
        span = m.to_source(a, a + len(short)) if short != value and len(short) > 4 else (e.start, e.end)
        out.append(Candidate(text[slice(*span)], "ORGANIZATION", start=span[0], end=span[1], restoration=short, rules=(e.rule,)))
    return out
