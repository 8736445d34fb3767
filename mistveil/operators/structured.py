"""Detectors of emails, phone and postal numbers, URLs and IP addresses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.chars import DIGITS, HYPHENS, WS, digits_col
from ..functions.patterns import EMAIL_JAVA, PHONE_DIGITS, SHAPES
from .spans import contained, outside, spans, tagged, trim_spans


def valid_email(v: Column) -> Column:
    """No dot at the edges of the local part or twice in it, no hyphen at a label's edges, an alphabetic last label."""
    local, labels = F.substring_index(v, "@", 1), F.split(F.substring_index(v, "@", -1), r"\.")
    dots = ~local.startswith(".") & ~local.endswith(".") & ~local.contains("..") & (local != "")
    whole = F.forall(labels, lambda x: (x != "") & ~x.startswith("-") & ~x.endswith("-"))
    return dots & (F.size(labels) > 1) & whole & F.element_at(labels, -1).rlike(r"^[A-Za-z]{2,}\z")


def valid_phone(v: Column) -> Column:
    return digits_col(v).rlike(rf"^{PHONE_DIGITS}\z")


def valid_url(v: Column) -> Column:
    """http(s) with a host that is localhost or has a dot; a user or port may be with it."""
    host = F.regexp_extract(v, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return v.rlike(r"(?i)^https?://") & ((F.lower(host) == "localhost") | host.contains("."))


def valid_ipv4(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: p.rlike(r"^(?:0|[1-9][0-9]{0,2})\z") & (p.try_cast("int") <= 255))


def valid_ipv6(v: Column) -> Column:
    groups = F.filter(F.split(v, ":"), lambda g: F.length(g) > 0)
    compressed = v.contains("::")
    shape = ~v.contains(":::") & ~v.rlike("^:[^:]") & ~v.rlike("[^:]:\\z") & ~(v.rlike("::.*::"))
    return shape & F.forall(groups, lambda g: F.length(g) <= 4) & F.when(compressed, F.size(groups) < 8).otherwise(F.size(groups) == 8)


def _found(text: Column, pattern: str, valid=None, trim: bool = True, hint: Column | None = None) -> Column:
    """``hint``: a cheap condition without which the pattern cannot match; most texts fail it."""
    column = spans(text, pattern)
    if valid is not None:
        column = F.filter(column, lambda x: valid(x["text"]))
    column = trim_spans(column) if trim else column
    if hint is not None:
        column = F.when(hint, column).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))
    return F.array_distinct(column)


def emails(text: Column) -> Column:
    return _found(text, EMAIL_JAVA, valid_email, hint=text.contains("@"))


def phones(text: Column) -> Column:
    return _found(text, SHAPES["phone"].java(), valid_phone, hint=text.rlike(f"[0０][{DIGITS}]{{1,4}}[{WS}{HYPHENS}][{DIGITS}]"))


def postal_codes(text: Column) -> Column:
    return _found(text, SHAPES["postal"].java(), hint=text.rlike(f"[{DIGITS}]{{3}}[{HYPHENS}][{DIGITS}]{{4}}"))


def urls(text: Column) -> Column:
    found = F.filter(_found(text, SHAPES["url"].java(), hint=text.contains("://")), lambda x: valid_url(x["text"]))
    return F.array_distinct(found)


def ip_addresses(text: Column) -> Column:
    return F.array_distinct(F.concat(_found(text, SHAPES["ipv4"].java(), valid_ipv4, trim=False, hint=text.rlike("[0-9]\\.[0-9]")), _found(text, SHAPES["ipv6"].java(), valid_ipv6, trim=False, hint=text.rlike(":[A-Fa-f0-9:]"))))


def structured(text: Column) -> Column:
    """All of them in detector order, as (category, text, start, end): postal codes inside phones and IPs inside URLs go."""
    phone, url = phones(text), urls(text)
    return F.array_distinct(
        F.concat(
            tagged(emails(text), "EMAIL"),
            tagged(phone, "PHONE"),
            tagged(outside(postal_codes(text), phone), "POSTAL_CODE"),
            tagged(url, "OTHER"),
            tagged(outside(ip_addresses(text), url), "OTHER"),
        )
    )


__all__ = ["contained", "emails", "ip_addresses", "phones", "postal_codes", "structured", "urls"]
