"""Detectors of dates of birth, credentials, addresses, titles and person names in one text."""

from __future__ import annotations

import json
import re
from functools import lru_cache

from ..functions.chars import DIGITS, KANJI, LETTERS, WS, digits_of, trim
from ..functions.lexicon import ERAS, PERSON_FIELDS, TITLES, surname_pattern
from .addresses import ADDRESS_LABEL, scanner
from .candidates import Candidate, at, unique

S = f"[{WS}]"
# Words and marks that may stand beside a name, what is no person, labels of people.
_PARTICLE = "の|へ|が|は|を|に|と|も|や|で|より|から|まで|です|である|として|について"
_STOP = f"[{WS}、。，,.！？!?「」『』（）()【】\\[\\]\"'：:;；・/]"
AFTER_TITLE = f"(?=\\Z|{_STOP}|(?:{_PARTICLE}))"
AFTER_NAME = f"(?=\\Z|[{WS}、。，,.]|さん|様|氏|から|として|である|です|が|は|を|に|へ|と)"
_NAMED = "一-龥々ぁ-んァ-ヶー" + LETTERS + DIGITS
_ITEM = f"(?:^|[\\r\\n])[ 　]*(?:[-*・]|[{DIGITS}]+[.)．、])[ 　]*"
_NOT_PERSON = re.compile("(?:製作所|医院|橋梁|株式会社|有限会社|病院|学校|大学|銀行|公園|模型店|交差点|駅|線|川|峠|材料|部署|地方|側)\\Z")
_LABELS = "氏名|名前|名義人|担当者?|責任者|患者氏名|申請者|代表者|作成者|承認者|確認者|所有者|利用者|顧客"

# Dates of birth -------------------------------------------------------------------------

# Labels, forms of dates, quotes.
_BIRTH = re.compile("(?:生年月日|誕生日|生まれた日|DOB)", re.I)
_D = f"[{DIGITS}]"
_DATES = (
    re.compile(f"({'|'.join(ERAS)})(元|{_D}{{1,2}})年({_D}{{1,2}})月({_D}{{1,2}})日"),
    re.compile(f"({_D}{{4}})年({_D}{{1,2}})月({_D}{{1,2}})日"),
    re.compile(f"({_D}{{4}})([-－/／.．])({_D}{{1,2}})\\2({_D}{{1,2}})"),
)
_QUOTES = {"「": "」", "『": "』", '"': '"', "'": "'", "“": "”", "‘": "’"}


def valid_date(y: int, m: int, d: int) -> bool:
    leap = y % 400 == 0 or y % 4 == 0 and y % 100 != 0
    return 1 <= y <= 9999 and 1 <= m <= 12 and 1 <= d <= (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


def _date_end(text: str, start: int) -> int | None:
    number = lambda s: int(digits_of(s) or -1)
    if m := _DATES[0].match(text, start):
        before, first, last = ERAS[m[1]]
        years = 1 if m[2] == "元" else number(m[2])
        y, mo, d = before + years, number(m[3]), number(m[4])
        if years >= 1 and valid_date(y, mo, d) and first <= y * 10000 + mo * 100 + d <= last:
            return m.end()
    if (m := _DATES[1].match(text, start)) and valid_date(*map(number, m.groups())):
        return m.end()
    if (m := _DATES[2].match(text, start)) and valid_date(number(m[1]), number(m[3]), number(m[4])):
        return m.end()
    return None


def birth_dates(text: str) -> list[Candidate]:
    """A real date right behind a label, perhaps quoted; of an era, one within it."""
    out = []
    for m in _BIRTH.finditer(text):
        if m[0].isascii() and (re.match("[A-Za-z0-9_]", text[max(0, m.start() - 1) : m.start()]) or re.match("[A-Za-z0-9_]", text[m.end() : m.end() + 1])):
            continue
        i = re.compile("[ \t　]*(?:[は:：=＝][ \t　]*)?").match(text, m.end()).end()
        quote = _QUOTES.get(text[i : i + 1])
        i += quote is not None
        end = _date_end(text, i)
        if end is None or re.match(_D, text[end : end + 1]) or quote and text[end : end + 1] != quote:
            continue
        out.append(Candidate(text[i:end], "OTHER", start=i, end=end))
    return unique(out)


# Credentials (derived from the documented contract) --------------------------------------

_CREDENTIAL = re.compile(
    "(?:ユーザー?(?:ID|名)|ログイン(?:ID|名)|アカウント(?:ID|名)?|パスワード|暗証番号|user(?:[ _-]?(?:id|name))?|login(?:[ _-]?id)?|password|passwd|ID)"
    "[ \t　]*(?:は[ \t　]*)?(?:"
    "「([^」\r\n]{1,128})」|『([^』\r\n]{1,128})』|[\"“]([^\"”\r\n]{1,128})[\"”]|'([^'\r\n]{1,128})'"
    "|(?:(?<=[ \t　])|[:：=＝][ \t　]*)([!#-&(-~]{3,128}))",
    re.I,
)


def credentials(text: str) -> list[Candidate]:
    """The quoted value behind an ID, login or password label, or the ASCII one behind a colon, equals sign or space."""
    out = []
    for m in _CREDENTIAL.finditer(text):
        if text[m.start()].isascii() and m.start() and re.match("[A-Za-z0-9_]", text[m.start() - 1]):
            continue
        k = next(i for i in range(1, 6) if m[i] is not None)
        out += at(text, m.start(k), m.end(k), "SECRET", trimmed=k == 5)
    return unique(out)


# Addresses and titles -------------------------------------------------------------------


_TOWN = re.compile("[市区町村]")
_LABEL = re.compile(ADDRESS_LABEL)


def addresses(text: str) -> list[Candidate]:
    out = []
    if _TOWN.search(text):
        for start, end in scanner().find(text):
            label = _LABEL.match(text, start, end)
            out += at(text, label.end() if label else start, end, "ADDRESS")
    return unique(out)


@lru_cache(maxsize=32)
def _compiled(name: str, names: str, other: str = "") -> re.Pattern:
    full = f"(?:{names})[ 　]*[{KANJI}]{{1,4}}"
    return re.compile(
        {
            # Where a name stands in each of the patterns.
            "titled": f"(?:^|[^{KANJI}])((?:{names})[ 　]*(?:[{KANJI}]{{1,4}})?[ 　]*(?:{TITLES})){AFTER_TITLE}",
            "any titled": f"(?:^|[^{KANJI} 　]|[はがをにへともやでのりら])[ 　]*([{KANJI}]{{1,20}}[ 　]*(?:{TITLES})){AFTER_TITLE}",
            "alone": f"(?:^|[^{_NAMED}])((?:{names})[{KANJI}]{{1,4}})(?=\\Z|[^{_NAMED}])",
            "ambiguous alone": f"(?:^|[^{_NAMED}])((?:{names})[{KANJI}]{{2,4}})(?=\\Z|[^{_NAMED}])",
            "surname label": f"(?:^|[^{_NAMED}])(?:姓|名字|苗字)[ 　]*(?:[:：=]|は)[ 　]*({names})(?=\\Z|[{WS}、。，,.！？!?（）()【】\\[\\]])",
            "listed surname": f"{_ITEM}({names})(?=\\Z|[\\r\\n 　、。，,.！？!?|])",
            "listed": f"{_ITEM}((?:{names})[{KANJI}]{{1,4}})(?=\\Z|[\\r\\n 　、。，,.！？!?|])",
            "spaced": f"(?:^|[^{KANJI}])((?:{names})[ 　]+[{KANJI}]{{1,4}}){AFTER_NAME}",
            "contextual": f"(?:氏名|名義人|口座名義|顧客である|[一-龥々ぁ-んァ-ヶー・A-Za-z0-9]+(?:部長|担当|担当者|部)の)[ 　]*({full}){AFTER_NAME}",
            "possessive": f"(?:会社|法人|組織|事業者|テクノロジー|ソリューションズ)の[ 　]*({full}){AFTER_NAME}",
            "labelled": f"(?:{_LABELS})[ 　]*(?:[:：=]|は|が)?[ 　]*({names})(?!(?:[ 　]+[{KANJI}])){AFTER_TITLE}",
            "one kanji": f"(?:{names})[ 　]+[{KANJI}]\\Z",
            "ruby": f"(?:^|(?<=[\\r\\n|]))[ \\t]*(?:[-*+][ \\t]+)?((?:{names})[{KANJI}]{{1,4}})([ぁ-ゖー]{{4,12}})(?=[ \\t]*(?:\\Z|\\r?\\n|\\|))",
            "full": full,
        }[name]
    )


def pattern(name: str, kind: str = "all") -> re.Pattern:
    return _compiled(name, surname_pattern(kind))


_MORE = re.compile(f"[ 　]+[{KANJI}]{AFTER_NAME}")


def _longer(text: str, start: int, end: int, limit: int | None = None) -> int:
    """Behind a surname and one spaced kanji, one more spaced kanji belongs to the name (OCR spacing)."""
    if pattern("one kanji").match(text[start:end]) and (m := _MORE.match(text if limit is None else text[:limit], end)):
        return m.end()
    return end


def _by(text: str, name: str, kind: str = "all", longer: bool = False) -> list[Candidate]:
    out = []
    for m in pattern(name, kind).finditer(text):
        out += at(text, m.start(1), _longer(text, m.start(1), m.end(1)) if longer else m.end(1), "PERSON")
    return out


_KANJI = re.compile(f"[{KANJI}]")


def titled_names(text: str) -> list[Candidate]:
    if not _KANJI.search(text):
        return []
    return unique(_by(text, "titled") + [c for c in _by(text, "any titled") if not c.text.endswith("仕様")])


_ENGLISH = f"(?:[A-Z][a-z]+|[A-Z]{{2,}})(?:[{WS}]+(?:[A-Z][a-z]+|[A-Z]{{2,}})){{1,3}}"
_AFTER_ENGLISH = f"(?=\\Z|[{WS}、。，,.]|さん|様|氏|から|として|である|です|が|は|を|に|へ)"
_LABELLED_ENGLISH = re.compile(f"(?:氏名|名義人|口座名義){S}*(?:[:：=]{S}*)?({_ENGLISH}){_AFTER_ENGLISH}")


def person_names(text: str) -> list[Candidate]:
    """Names by a surname dictionary and context; the ten patterns in the order in which they are emitted."""
    out = []
    if _KANJI.search(text):
        out += [c for c in _by(text, "alone", "clear") + _by(text, "ambiguous alone", "ambiguous") if not _NOT_PERSON.search(c.text)]
        out += _by(text, "surname label") + _by(text, "listed surname", "ambiguous") + _by(text, "listed")
        out += _by(text, "spaced", longer=True) + _by(text, "contextual", longer=True) + _by(text, "possessive", longer=True)
        out += _by(text, "labelled", "ambiguous")
        for m in _LABELLED_ENGLISH.finditer(text):
            out += at(text, m.start(1), m.end(1), "PERSON")
    return unique(out + structured_names(text))


# Names in key-value lines, tables and fenced data ----------------------------------------

# Fields, fences and full names in data.
_FENCE = re.compile("```([A-Za-z0-9_-]*)[^\\r\\n]*\\r?\\n(.*?)\\r?\\n```", re.S)
_FIELD = re.compile(f"{S}*([一-龥々ぁ-んァ-ヶーA-Za-z][^:：=|]{{0,31}}){S}*[:：=]{S}*(.+?){S}*\\Z")
_JSON_FIELD = re.compile('"((?:[^"\\\\]|\\\\.)*)"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)"')
_FULL_ENGLISH = re.compile("(?:[A-Z][a-z]+|[A-Z]{2,})(?:[ 　]+(?:[A-Z][a-z]+|[A-Z]{2,})){1,3}")
_RULE = re.compile(":?-{3,}:?\\Z")


def is_person_field(name: str) -> bool:
    return re.sub("[*_`\"'“”‘’\\-" + WS + "]", "", name).lower() in PERSON_FIELDS


def _lines(text: str, base: int = 0) -> list[tuple[int, str]]:
    out = []
    for line in text.split("\n"):
        out.append((base, line.removesuffix("\r")))
        base += len(line) + 1
    return out


def _names_within(text: str, start: int, end: int) -> list[Candidate]:
    out = []
    for japanese in (True, False):
        found = pattern("full") if japanese else _FULL_ENGLISH
        letter = re.compile("[一-龥々ぁ-んァ-ヶー]" if japanese else "[A-Za-z]")
        for m in found.finditer(text[:end], start):
            stop = _longer(text, m.start(), m.end(), end) if japanese else m.end()
            if not (letter.match(text[m.start() - 1 : m.start()] if m.start() else "") or letter.match(text[stop : stop + 1])):
                out += at(text, m.start(), stop, "PERSON")
    return out


def _cells(line: tuple[int, str]) -> list[tuple[int, int, str]]:
    """Cells of a Markdown table line: start, end and trimmed text; an escaped bar is text."""
    base, text = line
    if "|" not in text:
        return []
    cuts = [m.start() for m in re.finditer("(?<!\\\\)\\|", text)]
    edges = [-1, *cuts, len(text)]
    parts = [(a + 1, b) for a, b in zip(edges, edges[1:])]
    if parts and not trim(text[slice(*parts[0])]):
        parts = parts[1:]
    if parts and not trim(text[slice(*parts[-1])]):
        parts = parts[:-1]
    out = []
    for a, b in parts:
        value = text[a:b]
        lead = len(value) - len(value.lstrip())
        out.append((base + a + lead, base + a + lead + len(value.strip()), value.strip()))
    return out


def _delimited(line: tuple[int, str], sep: str) -> list[tuple[int, int, str]]:
    """Cells of a CSV or TSV line, quotes with doubled quotes inside."""
    base, text = line
    out, i = [], 0
    while i <= len(text):
        m = re.compile(f'[ ]*"((?:[^"]|"")*)"[ ]*(?={re.escape(sep)}|\\Z)').match(text, i) or re.compile(f"([^{sep}]*)").match(text, i)
        value = m[1]
        lead = len(value) - len(value.lstrip())
        out.append((base + m.start(1) + lead, base + m.start(1) + lead + len(value.strip()), value.strip().replace('""', '"')))
        i = m.end() + 1
        if m.end() >= len(text):
            break
    return out


def structured_names(text: str) -> list[Candidate]:
    out = []
    lines = _lines(text)
    for base, line in lines:
        m = _FIELD.match(line) if any(c in line for c in ":：=") else None
        if m and is_person_field(m[1]):
            out += _names_within(text, base + m.start(2), base + m.end(2))
    i = 0
    while i < len(lines) - 2:
        head = _cells(lines[i])
        column = next((k for k, c in enumerate(head) if is_person_field(c[2])), None)
        rule = _cells(lines[i + 1]) if column is not None else []
        if column is None or len(rule) != len(head) or not all(_RULE.match(c[2]) for c in rule):
            i += 1
            continue
        i += 2
        while i < len(lines) and len(row := _cells(lines[i])) == len(head):
            out += _names_within(text, row[column][0], row[column][1])
            i += 1
    for m in _FENCE.finditer(text):
        kind, body, base = m[1].lower(), m[2], m.start(2)
        if kind == "json":
            try:
                json.loads(body)
            except ValueError:
                continue
            for f in _JSON_FIELD.finditer(body):
                if is_person_field(json.loads(f'"{f[1]}"')):
                    out += _names_within(text, base + f.start(2), base + f.end(2))
        elif kind in ("csv", "tsv"):
            rows = [x for x in _lines(body, base) if trim(x[1])]
            sep = "\t" if kind == "tsv" else ","
            for k in (k for k, c in enumerate(_delimited(rows[0], sep)) if is_person_field(c[2])) if len(rows) > 1 else ():
                for row in rows[1:]:
                    cells = _delimited(row, sep)
                    if k < len(cells):
                        out += _names_within(text, cells[k][0], cells[k][1])
    return unique(out)


__all__ = ["addresses", "birth_dates", "credentials", "person_names", "structured_names", "titled_names"]
