"""Normalization of whole documents, applied on request: text, provenance of each character, events and a summary."""

from __future__ import annotations

import re
import unicodedata

from ..functions.chars import fold_fullwidth
from ..functions.chars import FULLWIDTH
from ..functions.patterns import EMAIL_LOCAL

# Hyphens, list items, labels and the numbers that are joined.
_HYPHENS = "‐‑‒–—―−﹣－"
_ITEM = re.compile("(?:\\s{0,3}(?:[・●○■□※＊*-]|\\d+[.)]|[（(]\\d+[）)]|[①-⑳]|[ア-ン][.)]|第\\d+))\\s*")
_HEADING, _RULE = re.compile("\\s{0,3}#{1,6}(?:\\s|\\Z)"), re.compile("\\s{0,3}(?:[-*_]\\s*){3,}\\Z")
_LABELS = "氏名|名前|担当者|住所|所在地|郵便番号|電話番号|携帯番号|FAX|ファックス|メールアドレス|生年月日|勤務先|会社名|口座番号|会員番号|顧客番号|契約番号|証明書番号"
_H = f"{_HYPHENS}-"
_PHONE = re.compile(f"[0-9][0-9\\s{_H}]{{5,}}[0-9]")
_B = " \\t　"  # blanks that may stand before a postal code; a run of them is begun at its start only
_POSTAL = re.compile(
    f"(?:(?<![0-9-])〒[{_B}]*+|(?<![0-9{_B}-])[{_B}]++|(?<=[0-9-][{_B}])[{_B}]++|(?<![0-9-]))"
    f"[0-9]{{3}}(?:[\\s　]*+[{_H}][\\s　]*+|[\\s　]++)[0-9]{{4}}(?![\\s　]*+[{_H}][\\s　]*+[0-9])"
)
_DATE = re.compile("[0-9]{4}[\\s　]*年[\\s　]*[0-9]{1,2}[\\s　]*月[\\s　]*[0-9]{1,2}[\\s　]*日")
_TIME = re.compile("[0-9]{1,2}[\\s　]*[:：][\\s　]*[0-9]{2}(?:[\\s　]*[:：][\\s　]*[0-9]{2})?")
_JP = "一-龥々ぁ-んァ-ヶ0-9"
# Blanks inside an email: spaces and at most one line break. Domains are read forwards from the @, local parts backwards from it; no
# quantifier here gives back what it took, so each @ costs what it reads.
_GAP = "[ \\t]*+(?:\\n[ \\t]*+)?+"
_LABEL = f"[A-Za-z0-9](?:[A-Za-z0-9]++|-{_GAP}(?=[A-Za-z0-9]))*+"
_DOMAIN = re.compile(f"{_GAP}{_LABEL}(?:{_GAP}\\.{_GAP}{_LABEL})++(?!{_GAP}\\.)(?![A-Za-z0-9._%+@-])")
_BLANKS = "(?:[ \\t]++(?:\\n[ \\t]*+)?+|\\n[ \\t]*+)(?!\\n)"
_LOCAL_BACK = re.compile(f"(?:[{EMAIL_LOCAL}]++|(?<![^.-]){_BLANKS}|{_BLANKS}(?=[.-]))*+")
_JOIN = re.compile("(?<![ \\t])[ \\t]*+\\n[ \\t]*+")


class Work:
    """A text under edit; each character knows its source range and the rules that made it."""

    def __init__(self, source: str):
        self.text = source
        self.starts, self.ends = list(range(len(source))), list(range(1, len(source) + 1))
        self.rules: list[str | None] = [None] * len(source)
        self.events: list[tuple[str, str, int, int]] = []

    def edit(self, edits: list[tuple[int, int, str, str, str]]) -> None:
        """(start, end, replacement, rule, kind), not overlapping; one copy of the text for all of them."""
        if not edits:
            return
        text, starts, ends, rules, at = [], [], [], [], 0
        for a, b, new, rule, kind in sorted(edits):
            first, last = self.starts[a], self.ends[b - 1]
            self.events.append((rule, kind, first, last))
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [first] * len(new)
            ends += self.ends[at:a] + [last] * len(new)
            rules += self.rules[at:a] + [rule] * len(new)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.starts, self.ends, self.rules = starts + self.starts[at:], ends + self.ends[at:], rules + self.rules[at:]

    def sub(self, pattern, rule: str, kind: str, new) -> None:
        text = self.text
        guarded = protected(text)
        edits = []
        for m in re.finditer(pattern, text):
            value = new(m) if callable(new) else new
            if value is not None and value != m[0] and m.end() > m.start() and not overlaps(guarded, *m.span()):
                edits.append((*m.span(), value, rule, kind))
        self.edit(edits)


def protected(text: str) -> list[tuple[int, int]]:
    """Fenced blocks and lines indented by four spaces or more, merged where they touch."""
    if "```" not in text and "~~~" not in text and "    " not in text:
        return []
    out, at, fence = [], 0, None
    for line in text.split("\n"):
        end = at + len(line)
        if re.match("\\s*(?:```|~~~)", line):
            if fence is None:
                fence = at
            else:
                out.append((fence, end))
                fence = None
        elif fence is not None or re.match(" {4,}\\S", line):
            out.append((at, min(len(text), end + 1)))
        at = end + 1
    if fence is not None:
        out.append((fence, len(text)))
    return coalesce(out)


def coalesce(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Touching or overlapping ranges become one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def overlaps(ranges: list[tuple[int, int]], a: int, b: int) -> bool:
    return any(a < y and x < b for x, y in ranges)


def _compact(text: str) -> str:
    return re.sub("[ \\t\\r\\n　]", "", text)


def _plain_hyphens(text: str) -> str:
    return text.translate({ord(c): "-" for c in _HYPHENS})


def _validated(w: Work, pattern, name: str, new) -> None:
    text = w.text
    guarded = protected(text)
    edits = []
    for m in pattern.finditer(text):
        value = new(_compact(m[0]))
        if value and value != m[0] and not overlaps(guarded, *m.span()):
            broken = "\n" in m[0]
            edits.append((*m.span(), value, f"{name}_{'line_break' if broken else 'spacing'}", "line_break" if broken else "space"))
    w.edit(edits)


def _phone(v: str) -> str | None:
    return _plain_hyphens(v) if re.fullmatch("0[0-9]{9,10}", re.sub("[^0-9]", "", v)) else None


def _postal(v: str) -> str | None:
    return _plain_hyphens(v) if re.fullmatch("〒?[0-9]{3}-[0-9]{4}", _plain_hyphens(v)) else None


def _date(v: str) -> str | None:
    from .names import valid_date

    return v if valid_date(*map(int, re.findall("[0-9]+", v))) else None


def _time(v: str) -> str | None:
    p = [int(x) for x in re.findall("[0-9]+", v)]
    return v.replace("：", ":") if p[0] < 24 and all(x < 60 for x in p[1:]) else None


def _email(v: str) -> bool:
    local, _, domain = v.partition("@")
    labels = domain.split(".")
    return len(v) <= 254 and bool(re.fullmatch(f"[{EMAIL_LOCAL}]+", local)) and len(labels) > 1 and all(re.fullmatch("[A-Za-z0-9-]+", x) and "-" not in (x[0], x[-1]) for x in labels)


def _emails(w: Work) -> None:
    text = w.text
    guarded, edits, last = protected(text), [], 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at - _LOCAL_BACK.match(text[last:at][::-1]).end()
        value = text[start : domain.end()] if domain and start < at else ""
        last = at + 1
        if value and _email(new := _compact(value)) and new != value and not overlaps(guarded, start, domain.end()):
            broken = "\n" in value
            edits.append((start, domain.end(), new, f"email_{'line_break' if broken else 'spacing'}", "line_break" if broken else "space"))
            last = domain.end()
        at = text.find("@", last)
    w.edit(edits)


def _joiner(before: str, after: str) -> str:
    a, b = before[-1:], after[:1]
    return " " if re.match("[A-Za-z0-9]", a) and re.match("[A-Za-z0-9]", b) and not (re.match(f"[{_JP}]", a) and re.match(f"[{_JP}]", b)) else ""


def _join_rule(before: str, after: str, other: str) -> str:
    if re.search("氏名|名前|担当者", before):
        return "person_line_break"
    if re.search("都|道|府|県|市|区|町|村|丁目|番地?|号", before + after):
        return "address_line_break"
    if re.search("株式会社|有限会社|合同会社|会社|法人|センター|ソリューションズ|部|課|室|グループ", before + after):
        return "organization_line_break"
    return other


def _joins(w: Work, other: str, lists: bool) -> None:
    """Joins lines: the continuation of a list item, or in general lines that end no sentence."""
    text = w.text
    guarded, edits, listed, done = protected(text), [], False, 0
    for m in _JOIN.finditer(text):
        a, b = m.span()
        while done < a:  # the list state up to this break, read once
            end = text.find("\n", done)
            end = a if end < 0 or end > a else end
            line = text[done:end]
            listed = bool(line.strip()) and (listed or bool(_ITEM.match(line)))
            done = end + 1
        if overlaps(guarded, a, b + 1):  # nor is a line joined to a block that begins behind it
            continue
        before = text[text.rfind("\n", 0, a) + 1 : a].rstrip()
        stop = text.find("\n", b)
        after = text[b : stop if stop >= 0 else len(text)].lstrip()
        if not before or not after or _ITEM.match(after) or _HEADING.match(after) or _RULE.match(after):
            continue
        if listed if lists else not (before[-1] in "。！？.!?" or "|" in before + after or any(x <= a <= y for x, y in guarded)):
            new = _joiner(before, after)
            edits.append((a, b, new, _join_rule(before, after, other), "line_break" if new else "join"))
    w.edit(edits)


def normalize_document(text: str, mode: str = "standard", mappings: bool = True) -> dict:
    """normalized_text, mappings, events, summary and changed_location_count. ``detection_priority`` also joins lines.

    ``mappings`` has an item for each character; who doesn't need them leaves them out.
    """
    w = Work(text)
    edits = []
    for m in () if unicodedata.is_normalized("NFC", text) else re.finditer("[^\\u0300-\\u036f\\u3099\\u309a][\\u0300-\\u036f\\u3099\\u309a]+|[\\u0340-\\u0345\\u212a\\u212b\\uf900-\\ufaff]", text):
        new = unicodedata.normalize("NFC", m[0])
        if new != m[0]:
            edits.append((*m.span(), new, "unicode_nfc", "character"))
    w.edit(edits)
    w.sub("\\r\\n?", "line_ending", "line_break", "\n")
    w.sub("[\\u200b\\u2060\\ufeff\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]", "invisible_character", "character", "")
    w.sub("[\\u00a0\\u2007\\u202f\\u3000]", "special_whitespace", "space", " ")
    w.sub(f"[{FULLWIDTH[0]}-{FULLWIDTH[-1]}]", "fullwidth_ascii", "character", lambda m: fold_fullwidth(m[0]))
    _emails(w)
    for pattern, name, new in ((_PHONE, "phone", _phone), (_POSTAL, "postal_code", _postal), (_DATE, "date_time", _date), (_TIME, "date_time", _time)):
        _validated(w, pattern, name, new)
    whole = w.text
    guarded = protected(whole)
    edits = []
    for m in () if not re.search(_LABELS, whole) else re.finditer("^([^\\r\\n:：]{1,16})([ \\t]*+(?:[:：][ \\t]*+)?)\\n[ \\t]*([^\\r\\n]{1,256})$", whole, re.M):
        if re.fullmatch(_LABELS, m[1].strip()) and not overlaps(guarded, *m.span()):
            edits.append((m.end(2), m.start(3), "" if re.search("[:：]", m[2]) else " ", "label_value_line_break", "line_break"))
    w.edit(edits)
    _joins(w, "list_item_wrap", True)
    if mode == "detection_priority":
        w.sub(f"(?<=[{_JP}])[ 　](?=[{_JP}])", "japanese_inter_character_space", "space", "")
        _joins(w, "japanese_line_wrap", False)
    w.sub("[ \\t]{2,}", "excess_whitespace", "space", " ")
    w.sub("\\n{3,}", "excess_whitespace", "line_break", "\n\n")
    summary: dict[tuple[str, str], int] = {}
    events = _merged_events(w.events)
    for rule, kind, *_ in events:
        summary[rule, kind] = summary.get((rule, kind), 0) + 1
    return {
        "normalized_text": w.text,
        "mappings": [{"start": a, "end": b, "changed": r is not None, "rule_ids": [r] if r else []} for a, b, r in zip(w.starts, w.ends, w.rules)] if mappings else [],
        "events": [{"rule_id": r, "kind": k, "start": a, "end": b} for r, k, a, b in events],
        "summary": [{"rule_id": r, "kind": k, "count": n} for (r, k), n in summary.items()],
        "changed_location_count": len(coalesce([(a, b) for _, _, a, b in events])),
    }


def _merged_events(events: list[tuple[str, str, int, int]]) -> list[tuple[str, str, int, int]]:
    """In order of place; neighbours of one rule and kind that touch are one."""
    out: list[tuple[str, str, int, int]] = []
    for r, k, a, b in sorted(events, key=lambda e: (e[2], e[3])):
        if out and out[-1][:2] == (r, k) and a <= out[-1][3]:
            out[-1] = (r, k, out[-1][2], max(b, out[-1][3]))
        else:
            out.append((r, k, a, b))
    return out


def preview(source: str, result: dict) -> tuple[list[dict], list[dict]]:
    """Segments of the source, changed or not, and of the result, by change and rules."""
    before, at = [], 0
    for a, b in coalesce([(e["start"], e["end"]) for e in result["events"]]):
        if a > at:
            before.append({"text": source[at:a], "changed": False})
        before.append({"text": source[a:b], "changed": True})
        at = b
    if at < len(source):
        before.append({"text": source[at:], "changed": False})
    after: list[dict] = []
    for c, m in zip(result["normalized_text"], result["mappings"]):
        if after and after[-1]["rule_ids"] == m["rule_ids"]:
            after[-1]["text"] += c
        else:
            after.append({"text": c, "changed": m["changed"], "rule_ids": m["rule_ids"]})
    return before, after
