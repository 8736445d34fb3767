"""What emails, phone and postal numbers, URLs and IP addresses look like: one table for Java (Columns) and for Python."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .chars import DIGITS, HYPHENS, LETTERS, WS

# The shapes that are detected, and the characters that may not stand beside them.
EMAIL_LOCAL = r"A-Za-z0-9.!#$%&'*+/=?^_`{|}~-"
EMAIL_DOMAIN = "A-Za-z0-9.-"
EMAIL_BESIDE = "A-Za-z0-9._%+-"
NUMBER_BESIDE = f"{DIGITS}{LETTERS}{HYPHENS}"
PHONE = f"[0０][{DIGITS}]{{1,4}}[{WS}{HYPHENS}][{DIGITS}]{{1,4}}[{WS}{HYPHENS}][{DIGITS}]{{3,4}}"
POSTAL = f"(?:〒[{WS}]*)?[{DIGITS}]{{3}}[{HYPHENS}][{DIGITS}]{{4}}"
URL = r"https?://[A-Za-z0-9._~:/?@!$&*+,;=%#-]+"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
IPV6 = "[A-Fa-f0-9:]*:[A-Fa-f0-9:]+"
PHONE_DIGITS = r"(?:0[0-9]{9}|(?:020|050|060|070|080|090)[0-9]{8})"


@dataclass(frozen=True)
class Shape:
    """A value, and what may not stand before and behind it (the inside of character classes, or nothing)."""

    body: str
    before: str = ""
    after: str = ""
    any_case: bool = False

    def _pattern(self, body: str) -> str:
        return (f"(?<![{self.before}])" if self.before else "") + body + (f"(?![{self.after}])" if self.after else "")

    def java(self) -> str:
        """With an empty first group and the value as the second, as ``operators.spans`` wants it."""
        return "(?i)" * self.any_case + self._pattern(f"()({self.body})")

    def python(self) -> re.Pattern:
        return re.compile(self._pattern(f"(?:{self.body})"), re.I if self.any_case else 0)


SHAPES = {
    "phone": Shape(PHONE, NUMBER_BESIDE, NUMBER_BESIDE),
    "postal": Shape(POSTAL, NUMBER_BESIDE, NUMBER_BESIDE),
    "url": Shape(URL, any_case=True),
    "ipv4": Shape(IPV4, "0-9.", "0-9."),
    "ipv6": Shape(IPV6, "A-Za-z0-9:", "A-Za-z0-9:"),
}

# An email's domain is the whole run behind the @, so its labels are looked at by conditions and no group is repeated: Java
# matches a repeated group by recursion. A local part begins with its run of characters, or behind one that
# follows the email before.
EMAIL_TAIL = rf"(?=[A-Za-z0-9-]+\.)(?![{EMAIL_DOMAIN}]*\.\.)[{EMAIL_DOMAIN}]++(?<!\.)(?![{EMAIL_BESIDE}])"
EMAIL_JAVA = rf"((?<![{EMAIL_LOCAL}])|\G[^{EMAIL_BESIDE}])([{EMAIL_LOCAL}]++@{EMAIL_TAIL})"
_RUN_AND_AT = re.compile(f"(?<![{EMAIL_LOCAL}])[{EMAIL_LOCAL}]++@")
_TAIL = re.compile(EMAIL_TAIL)


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of emails, valid or not, in time linear in the text."""
    out, last = [], -1
    for m in _RUN_AND_AT.finditer(text):
        start = last + 1 if last > m.start() else m.start()
        tail = _TAIL.match(text, m.end()) if start < m.end() - 1 else None
        if tail:
            last = tail.end()
            out.append((start, last))
    return out


def valid_email(value: str) -> bool:
    """No dot at the edges of the local part or twice in it, no hyphen at a label's edges, an alphabetic last label."""
    local, _, domain = value.partition("@")
    labels = domain.split(".")
    if not local or local[0] == "." or local[-1] == "." or ".." in local or len(labels) < 2:
        return False
    return all(x and x[0] != "-" and x[-1] != "-" for x in labels) and len(labels[-1]) >= 2 and labels[-1].isascii() and labels[-1].isalpha()
