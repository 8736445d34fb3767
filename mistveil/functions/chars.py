"""Character classes and foldings. White space is that of ECMAScript, spelled out for Java and Python patterns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For use inside a character class.
WS = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
WS_CHARS = "\t\n\x0b\f\r " + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
DIGITS = "0-9０-９"
LETTERS = "A-Za-zＡ-Ｚａ-ｚ"
HYPHENS = "\\-‐‑‒–—―－ーｰ"
KANJI = "一-龥々"
HAN = "⺀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f"
KATAKANA = "ァ-ヺヽ-ヿㇰ-ㇿｦ-ｯｱ-ﾝ"
HIRAGANA = "ぁ-ゖゝ-ゟ"
#: Stripped from both ends of a detected value.
EDGE = WS_CHARS + "\"'“”‘’「『（(【[" + "。、，,.;:!?！？」』）)】]"

FULLWIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_FOLD = str.maketrans(FULLWIDTH, ASCII)


def fold_fullwidth(text: str) -> str:
    return text.translate(_FOLD)


def fold_fullwidth_col(column: Column) -> Column:
    return F.translate(column, FULLWIDTH, ASCII)


def digits_of(text: str) -> str:
    """ASCII digits of a text, full-width ones folded."""
    return "".join(c for c in fold_fullwidth(text) if c in "0123456789")


def digits_col(column: Column) -> Column:
    return F.regexp_replace(F.translate(column, "０１２３４５６７８９", "0123456789"), "[^0-9]", "")


def trim(text: str) -> str:
    return text.strip(WS_CHARS)


def blank(column: Column) -> Column:
    """Nothing but white space."""
    return column.rlike(f"^[{WS}]*\\z")


def trim_edges(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in EDGE:
        start += 1
    while end > start and text[end - 1] in EDGE:
        end -= 1
    return start, end


def nfc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def utf16_offset(column: Column, offset: Column) -> Column:
    """UTF-16 units before a code point offset."""
    return (F.octet_length(F.encode(F.left(column, offset), "UTF-16BE")) / 2).cast("int")


def utf16_len(text: str) -> int:
    return len(text) + sum(ord(c) > 0xFFFF for c in text)
