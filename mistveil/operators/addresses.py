"""Japanese addresses: a scanner that looks for the parts of an address one behind the other.

An address is a municipality, perhaps behind its prefecture, a place name, a lot number and perhaps a building. The scanner
tries the municipalities that begin at a place, the longest name first; behind each it looks for the nearest lot number. From
then on nothing is tried again: what follows a municipality's end is looked up once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from ..functions.chars import HAN, HIRAGANA, KATAKANA
from ..functions.lexicon import PREFECTURES

# Characters of place names, of which some may not stand before an address; labels; numbers; endings.
PLACE = f"{HAN}{HIRAGANA}{KATAKANA}々ヶケー・"
_NOT_BEFORE = f"{HAN}{KATAKANA}々ヶケー"
_NUMBER = "[0-9０-９一二三四五六七八九十百千]+"
_LABELS = ("自宅住所", "登録住所", "配送先", "住所", "所在地", "送付先")
_BUILDINGS = ("ビル", "タワー", "マンション", "ハイツ", "コーポ", "館", "棟")
_NAME, _BETWEEN, _BUILDING = 12, 24, 40

ADDRESS_LABEL = f"(?:{'|'.join(_LABELS)})[ 　]*(?:は[ 　]*|[：:][ 　]*)?"


class Scanner:
    """``line_break``, if given, is a pattern that may stand between the parts."""

    def __init__(self, line_break: str = ""):
        maybe = f"(?:{line_break})?" if line_break else ""
        gap = f"(?:[ 　]+|{line_break})" if line_break else "[ 　]+"
        inside = f"[^\\n\\r、。;；!?！？]{{1,{_BUILDING}}}?"
        prefecture = f"(?:{'|'.join(PREFECTURES)})"
        self.break_ = re.compile(line_break) if line_break else None
        self.not_before = re.compile(f"[{_NOT_BEFORE}]")
        self.names = re.compile(f"[{PLACE}]{{1,{_BETWEEN}}}")
        self.prefecture = re.compile(prefecture)
        self.label = re.compile(f"(?:{'|'.join(_LABELS)})[ 　]*")
        self.mark = re.compile("[は：:][ 　]*")
        self.lot = re.compile(f"(?:{_NUMBER}丁目{maybe})?{_NUMBER}(?:番地|番(?:{maybe}{_NUMBER}号)?|号)|{_NUMBER}(?:[-－]{_NUMBER}){{1,3}}")
        self.building = re.compile(f"{gap}(?:{inside}(?:階|号室)|{inside}(?:{'|'.join(_BUILDINGS)}))")
        # Where an address can begin at all, so that most of a text is passed over by one search.
        town = f"(?:{prefecture}{maybe})?[{PLACE}]{{1,{_NAME}}}[市区郡町村]"
        self.before = re.compile(f"(?:{'|'.join(_LABELS)})|[^{_NOT_BEFORE}](?={town})")

    def _after(self, at: int, text: str) -> list[int]:
        """Where a part goes on behind another: over a line break if there is one, or right there."""
        m = self.break_.match(text, at) if self.break_ else None
        return [m.end(), at] if m and m.end() > at else [at]

    def _named(self, text: str, at: int, endings: str) -> Iterator[int]:
        """Ends of names with one of some endings, the longest name first."""
        run = self.names.match(text, at)
        for end in range(min(run.end(), at + _NAME) if run else at, at, -1):
            if text[end : end + 1] and text[end] in endings:
                yield end + 1

    def _municipalities(self, text: str, at: int) -> Iterator[int]:
        for city in self._named(text, at, "市"):
            yield from self._named(text, city, "区")
            yield city
        yield from self._named(text, at, "区")
        for county in self._named(text, at, "郡"):
            yield from self._named(text, county, "町村")
        yield from self._named(text, at, "町村")

    def _rest(self, text: str, at: int) -> int | None:
        """The end of the address whose municipality ends at a place."""
        for start in self._after(at, text):
            run = self.names.match(text, start)
            for end in range(start + 1, (run.end() if run else start) + 1):
                for there in self._after(end, text):
                    if lot := self.lot.match(text, there):
                        building = self.building.match(text, lot.end())
                        return building.end() if building else lot.end()
        return None

    def _address(self, text: str, at: int, known: dict[int, int | None]) -> int | None:
        """The end of the address that begins at a place. ``known``: ends by where a municipality ends."""
        m = self.prefecture.match(text, at)
        for start in [*(self._after(m.end(), text) if m else ()), at]:
            for town in self._municipalities(text, start):
                if town not in known:
                    known[town] = self._rest(text, town)
                if known[town] is not None:
                    return known[town]
        return None

    def _starts(self, text: str, at: int) -> Iterator[int]:
        """Where an address may begin that is found at a place: behind a label, at the start of the text, behind a character."""
        if m := self.label.match(text, at):
            if mark := self.mark.match(text, m.end()):
                yield mark.end()
            yield m.end()
        if at == 0:
            yield 0
        if at < len(text) and not self.not_before.match(text, at):
            yield at + 1

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """Spans of addresses, from the left, not overlapping; one may begin with its label."""
        at, known = 0, {}
        while at <= len(text):
            found = next(((start, end) for start in self._starts(text, at) if (end := self._address(text, start, known))), None)
            if found:
                yield found
                at = found[1]
                continue
            m = self.before.search(text, at + 1)
            if not m:
                return
            at = m.start()


@lru_cache(maxsize=2)
def scanner(line_break: str = "") -> Scanner:
    return Scanner(line_break)
