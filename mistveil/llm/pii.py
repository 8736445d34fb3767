"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The fixed patterns give email, ip, card and phone spans, which always stay. The field segments the text
around possible entities: candidate segments (of a bounded number of words, or one solid string of any length) are scored as a whole, by features of their shape, their
checksums and the words beside them, and dynamic programming chooses boundaries and types together, against leaving the
tokens outside. A field's segments that meet no base span are added: its types are those four and ``secret``.

Every place of the text is looked at. A candidate holds a digit, an at sign or a written-out one and reaches over few separators, so
the search runs over the stretches that may hold one, found by those characters alone; the score of outside tokens is zero, and the
result is that over the whole text. The weights are trained here, on sentences made from a seed, by the gradient of the
conditional likelihood over all segmentations.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import emit, lean, table

BASE = ("email", "ip", "card", "phone")
TYPES = (*BASE, "secret")
#: Longest entity of several words in tokens and characters.
MAX_TOKENS, MAX_CHARS = 24, 128

# Base spans -----------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot start inside digits: from their first one it would have been the same.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, by start and kind; linear in the text."""
    out = []
    at = text.find("@")
    last = 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


# Candidates and features ----------------------------------------------------------------

# Segments begin and end with words, so letters and digits in a row are one token.
_TOKEN = re.compile(r"[^\W_]+|\s+|.", re.S)
# Solid strings, without a name and an equals sign before them; these may be longer than other segments.
_LONG = re.compile(r"(?:-*[A-Za-z_][A-Za-z0-9_-]*=+)?((?:[A-Za-z0-9_-]{10,}\.){2}[A-Za-z0-9_-]{10,}|[A-Za-z0-9_/+=-]{25,})")
_NEAR = {"secret": "token key secret password passwd pwd apikey bearer auth clave", "phone": "phone tel call fax mobile telefon teléfono téléphone", "email": "mail email e-mail contact write correo courriel", "card": "card visa credit karte tarjeta carte payment", "ip": "ip host server address addr from"}
_WORDS = {w: t for t, ws in _NEAR.items() for w in ws.split()}
_OPEN = re.compile(r"""([A-Za-zäéöüè-]+)["']?\s*(?:[:=]|is|at)?\s*["']?$""")


def segment_features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole candidate segment; a type's weight is looked up for each."""
    s = text[start:end]
    digits = "".join(c for c in s if c in "0123456789")
    n, alpha = len(digits), sum(c.isalpha() for c in s)
    out = ["bias", f"len{min(12, len(s) // 4)}", f"digits{min(n, 20)}"]
    before, after = text[start - 1 : start], text[end : end + 1]
    out.append("left:" + ("edge" if not before else "space" if before.isspace() else "quote" if before in "\"'" else "word" if before.isalnum() else "mark"))
    out.append("right:" + ("edge" if not after else "space" if after.isspace() else "quote" if after in "\"'" else "word" if after.isalnum() else "stop" if after in ".,;:!?" else "mark"))
    m = _OPEN.search(text[max(0, start - 24) : start])
    if m and (t := _WORDS.get(m[1].lower())):
        out.append("near:" + t)
    if alpha and n and re.fullmatch(r"[A-Za-z0-9_/+=-]+|(?:[A-Za-z0-9_-]{10,}\.){2}[A-Za-z0-9_-]{10,}", s):
        out.append("solid" + str(min(4, len(s) // 8)))
        if re.fullmatch(r"[0-9a-f]+", s):
            out.append("hex" + str(min(4, len(s) // 8)))
    if alpha and not n:
        out.append("letters")
    if "@" in s or re.search(r"[(\[]at[)\]]", s):
        out.append("at")
        if re.search(r"\.[a-z]{2,}$", s):
            out.append("domain")
    if n and not alpha:
        dots = s.count(".")
        out.append("numeric" + ("+" if s[0] == "+" else "") + ("(" if "(" in s else ""))
        if re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", s):
            out.append("quad" if all(int(p) < 256 for p in s.split(".")) else "badquad")
        elif dots:
            out.append("dotted")
        if 12 <= n <= 19 and re.fullmatch(r"[0-9 -]+", s):
            out.append("luhn" if luhn(digits) else "noluhn")
        if re.fullmatch(r"\+?(?:[0-9]{1,3}[ .-])?\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{3,4}", s):
            out.append("dialled")
    if s[-1] in " .,-(":
        out.append("loose end")
    if s[0] in " .,-)":
        out.append("loose start")
    return out


_SOLID = re.compile(r"[0-9@]")
_AT = re.compile(r"[(\[](at)[)\]]")


# What no candidate holds or, but for numbers and written-out addresses, crosses: a blank, marks, a line break before a word.
_STOPS = frozenset(" |<>*#$%&!")
_STOP = re.compile(r"[ |<>*#$%&!]|\n(?!\s)")
_NUMBERS = re.compile(r"[+0-9 ().-]{7,}+")


def _left(text: str, at: int) -> int:
    while at and text[at - 1] not in _STOPS and (text[at - 1] != "\n" or text[at : at + 1].isspace()):
        at -= 1
    return at


def _right(text: str, at: int) -> int:
    m = _STOP.search(text, at)
    return m.start() if m else len(text)


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches that hold all candidates of the text; none crosses their ends. In time linear in the text.

    A candidate without a blank lies in a run between two stops, with a digit or an at sign (found by these), or with a
    written-out one; one with blanks is made of the characters of numbers, or has a blank beside a written-out at sign.
    """
    spans = []
    m = _SOLID.search(text)
    while m:
        hi = _right(text, m.end())
        lo = _left(text, m.start())
        if hi - lo >= 7:
            spans.append((lo, hi))
        m = _SOLID.search(text, hi)
    if spans or _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            numbers = m[0].strip(" ")
            if len(numbers) >= 7 and " " in numbers and _DIGIT.search(numbers):
                at = m.start() + len(m[0]) - len(m[0].lstrip(" "))
                spans.append((_left(text, at), _right(text, at + len(numbers))))
    if "at)" in text or "at]" in text:
        lo = hi = 0
        for m in _AT.finditer(text):
            if m.start() >= hi:
                lo, hi = _left(text, m.start()), _right(text, m.end())
            a = _left(text, lo - 1) if lo == m.start() and text[lo - 1 : lo] == " " else lo
            b = _right(text, hi + 1) if hi == m.end() and text[hi : hi + 1] == " " else hi
            spans.append((a, b))
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def candidates(text: str, lo: int, hi: int, of=segment_features) -> tuple[list[int], dict[int, list[tuple[int, list]]]]:
    """Token bounds of an island, and by end token the segments (start token, features) that may be entities.

    ``of`` makes something else of a segment than its features; segments that it makes nothing of are left out.
    """
    bounds = [lo] + [m.end() for m in _TOKEN.finditer(text, lo, hi)]
    found: dict[int, list] = defaultdict(list)
    n = len(bounds) - 1
    written = {m.start(1) for m in _AT.finditer(text, lo, hi)}
    solid = [bounds[i] in written or _SOLID.search(text, bounds[i], bounds[i + 1]) is not None for i in range(n)]
    reach = [0]
    for x in solid:
        reach.append(reach[-1] + x)
    for i in range(n):
        c = text[bounds[i]]
        if c.isspace() or c in ".,;:!?\"')]-":
            continue
        if i and text[bounds[i] - 1].isalnum() and c.isalnum():
            continue  # within a word
        size = 0
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            size = bounds[j] - bounds[i]
            d = text[bounds[j] - 1]
            if size > MAX_CHARS and j > i + 1 or d == "\n" or (d in "|<>*#$%&!" and d not in "+/="):
                break
            if size < 7 or reach[j] == reach[i] or d.isspace() or d in ".,;:!?\"'([-":
                continue
            if j < n and text[bounds[j]].isalnum() and d.isalnum():
                continue
            if " " in text[bounds[i] : bounds[j]] and not re.fullmatch(r"[+0-9 ().-]+|\S+ ?[(\[]at[)\]] ?\S+", text[bounds[i] : bounds[j]]):
                continue
            if held := of(text, bounds[i], bounds[j]):
                found[j].append((i, held))
    place = {b: i for i, b in enumerate(bounds)}
    for m in _LONG.finditer(text, lo, hi):
        end = m.end() - (len(m[0]) - len(m[0].rstrip("-")))
        for start in {m.start() + len(m[0]) - len(m[0].lstrip("-")), m.start(1) + len(m[1]) - len(m[1].lstrip("-"))}:
            i, j = place.get(start), place.get(end)
            if i is None or j is None or j <= i + 1 or (j - i <= MAX_TOKENS and end - start <= MAX_CHARS) or reach[j] == reach[i]:
                continue
            if not ((start and text[start - 1].isalnum() and text[start].isalnum()) or (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())):
                if held := of(text, start, end):
                    found[j].append((i, held))
    return bounds, found


# The field ------------------------------------------------------------------------------


def _score(weights: dict, t: str, features: list[str]) -> float:
    return sum(weights.get((t, f), 0.0) for f in features)


def decode(weights: dict, bounds: list[int], found: dict) -> list[tuple[int, int, str]]:
    """The best segmentation: entities (start, end, type); of equal ones that with fewer, earlier types."""
    return best_path(bounds, {j: [(i, [(t, _score(weights, t, features)) for t in TYPES]) for i, features in segments] for j, segments in found.items()})


def typed_scores(weights: dict):
    """For ``candidates``: the types of a segment that beat leaving it outside, with their scores; no other can be chosen."""
    table: dict = defaultdict(lambda: [0.0] * len(TYPES))
    for (t, f), x in weights.items():
        table[f][TYPES.index(t)] = x
    get, none = dict(table).get, [0.0] * len(TYPES)

    def of(text: str, start: int, end: int) -> list[tuple[str, float]]:
        scores = map(sum, zip(*[get(f, none) for f in segment_features(text, start, end)]))
        return [(t, s) for t, s in zip(TYPES, scores) if s > 0]

    return of


def best_path(bounds: list[int], scored: dict) -> list[tuple[int, int, str]]:
    """``decode`` of segments (start token, [(type, score)]) by end token."""
    n = len(bounds) - 1
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, scores in scored.get(j, ()):
            for t, x in scores:
                s = best[i] + x
                if s > best[j] + 1e-12:
                    best[j], back[j] = s, (i, t)
    out, j = [], n
    while j > 0:
        if back[j]:
            i, t = back[j]
            out.append((bounds[i], bounds[j], t))
            j = i
        else:
            j -= 1
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _gradient(weights: dict, n: int, found: dict, gold: set) -> dict:
    """Of the log likelihood of the gold segmentation: observed less expected features."""
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    segments = [(i, j, t, f, _score(weights, t, f)) for j in found for i, f in found[j] for t in TYPES]
    by_end, by_start = defaultdict(list), defaultdict(list)
    for x in segments:
        by_end[x[1]].append(x)
        by_start[x[0]].append(x)
    for j in range(1, n + 1):
        alpha[j] = alpha[j - 1]
        for x in by_end[j]:
            alpha[j] = _log_add(alpha[j], alpha[x[0]] + x[4])
    for i in range(n - 1, -1, -1):
        beta[i] = beta[i + 1]
        for x in by_start[i]:
            beta[i] = _log_add(beta[i], x[4] + beta[x[1]])
    out: dict = defaultdict(float)
    for i, j, t, features, s in segments:
        step = ((i, j, t) in gold) - math.exp(alpha[i] + s + beta[j] - alpha[n])
        if abs(step) > 1e-9:
            for f in features:
                out[t, f] += step
    return out


def _sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """Made text with known entities, and with numbers and words that are none."""
    word = lambda: "".join(rng.choice(["an", "ther", "on", "ver", "de", "la", "ción", "ment", "ü", "é", "st", "in"]) for _ in range(rng.randint(1, 4)))
    digit = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    base64 = lambda k, marks: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + marks) for _ in range(k))
    text, gold = "", []

    def add(s: str, t: str | None = None) -> None:
        nonlocal text
        if t:
            gold.append((len(text), len(text) + len(s), t))
        text += s

    def words(k: int) -> None:
        for _ in range(k):
            add(word() + rng.choice([" ", " ", " ", ", ", ". ", ".\n"]))

    def secret() -> str:
        kind = rng.random()
        if kind < 0.6:
            return hexa(rng.choice([32, 40, 64]))
        if kind < 0.7:
            return base64(86, "+/") + "=="
        if kind < 0.8:
            return "eyJ" + ".".join(base64(rng.randint(30, 150), "-_") + digit(1) for _ in range(3))
        return rng.choice(["sk", "ghp", "AKIA", "key"]) + rng.choice(["-", "_", ""]) + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789") for _ in range(24)) + digit(2)

    def card(good: bool) -> str:
        while True:
            d = rng.choice("3456") + digit(15)
            if luhn(d) == good:
                return " ".join(d[i : i + 4] for i in range(0, 16, 4)) if rng.random() < 0.4 else d

    words(rng.randint(1, 5))
    for _ in range(rng.randint(1, 2)):
        kind = rng.randrange(12)
        near = rng.choice([*_NEAR[TYPES[kind % 5]].split()]) + rng.choice([" ", ": ", " is ", " = "]) if rng.random() < 0.4 and kind < 6 else ""
        if kind == 0:
            add(near)
            add(f"{word()}.{digit(2)}@mail{digit(1)}.example.{rng.choice(['com', 'org', 'net'])}" if rng.random() < 0.7 else f"{rng.choice(['anna', 'max', 'lee'])}{digit(rng.choice([0, 2]))}{rng.choice(['(at)', ' (at) ', '[at]'])}example.org", "email")
        elif kind == 1:
            add(near)
            add(".".join(str(rng.randrange(256)) for _ in range(4)), "ip")
        elif kind == 2:
            add(near)
            add(card(True), "card")
        elif kind == 3:
            add(near)
            a, b, c = digit(3), digit(3), digit(4)
            add(rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {digit(3)} {digit(7)}", f"+1-{a}-{b}-{c}"]), "phone")
        elif kind in (4, 5):
            add(rng.choice(["token", "api_key", "secret", "password", "key"]) + rng.choice([' = "', ': "', "=", ": "]))
            add(secret(), "secret")
            if '"' in text[gold[-1][0] - 2 : gold[-1][0]]:
                add('"')
        elif kind == 6:
            add(card(False))
        elif kind == 7:
            add(f"{rng.randrange(1900, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}" + (f" {rng.randrange(24):02}:{rng.randrange(60):02}:00" if rng.random() < 0.5 else ""))
        elif kind == 8:
            add(f"{rng.randrange(256, 999)}.{rng.randrange(999)}.{digit(3)}.{digit(3)}" if rng.random() < 0.5 else f"v{digit(1)}.{digit(2)}.{digit(1)}")
        elif kind == 9:
            add(f"{digit(rng.randint(5, 11))}" if rng.random() < 0.5 else f"{digit(3)},{digit(3)},{digit(3)}.{digit(2)}")
        elif kind == 10:
            add(f"{word()}{digit(2)}-{word()}-{digit(3)}" if rng.random() < 0.5 else f"{word().upper()}_{digit(4)}_{word()}{digit(3)}x")
        else:
            add("https://example.org/" + word() + "/" + digit(4) + "/" + word() + ".html")
        add(rng.choice([" ", " ", ". ", ", ", "\n"]))
        words(rng.randint(1, 4))
    return text, gold


@lru_cache(maxsize=2)
def train(sentences: int = 700, rounds: int = 4, seed: int = 29) -> dict:
    """Weights (type, feature) -> float, the same for the same arguments."""
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, gold = _sentence(rng)
        bounds, found = candidates(text, 0, len(text))
        place = {b: i for i, b in enumerate(bounds)}
        data.append((len(bounds) - 1, found, {(place[a], place[b], t) for a, b, t in gold if a in place and b in place}))
    weights: dict = defaultdict(float)
    square: dict = defaultdict(lambda: 1.0)
    for _ in range(rounds):
        rng.shuffle(data)
        for n, found, gold in data:
            for k, g in _gradient(weights, n, found, gold).items():
                g -= 1e-4 * weights[k]
                square[k] += g * g
                weights[k] += 0.7 * g / math.sqrt(square[k])
    return dict(weights)


def all_spans(text: str, weights: dict, of=None) -> tuple[list, list]:
    """Base spans, and all spans (start, end, kind) by start and kind. ``of`` is ``typed_scores(weights)``, if it is made already."""
    base = base_spans(text)
    out = list(base)
    of = of or typed_scores(weights)
    starts, reached = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    for lo, hi in islands(text):
        bounds, scored = candidates(text, lo, hi, of)
        for a, b, t in best_path(bounds, scored) if scored else ():
            before = bisect_left(starts, b)  # base spans that start before the end
            if not before or reached[before - 1] <= a:
                out.append((a, b, TYPES.index(t)))
    return base, sorted(out, key=lambda x: (x[0], x[2]))


_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])
_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _listed(spans: list) -> str:
    return ",".join(f"{TYPES[k]}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts and hash of base spans, and all spans, for every row of ``docs``.

    Offsets are code points, ends exclusive. A null or empty text has no spans (the hash is that of nothing); a long
    one is searched whole, in time linear in it. Spans of one start are listed in the order of ``TYPES``. A segment of
    several words has at most ``MAX_TOKENS`` tokens and ``MAX_CHARS`` characters, a solid string any length.
    Repeated rows are searched each; a null doc_id stays null; other columns are not looked at. No rows, no result.
    """
    weights = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = typed_scores(weights)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text or "", weights, of)
                counts = [sum(k == i for _, _, k in base) for i in range(len(BASE))]
                rows.append((*counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every), len(every) - len(base)))
            yield emit(_SCHEMA, [batch.column(0), *zip(*rows)] if rows else [[]] * len(_SCHEMA))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), _DDL)


def redact_text(text: str, weights: dict, of=None) -> str:
    """Each span, or stretch of overlapping ones, replaced by the kind of the first, as in ``[EMAIL]``."""
    out, at = [], 0
    for s, e, k in all_spans(text, weights, of)[1]:
        if s >= at:
            out += [text[at:s], f"[{TYPES[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with spans replaced in ``text`` and ``n_chars``, if there is one, counted again.

    Null texts stay null and keep their n_chars, empty ones stay empty; long texts are searched whole. Of spans that
    overlap the first, then the first of ``TYPES``, names the replacement of their whole stretch. Repeated rows, null
    doc_ids and other columns are carried along. No rows, no result.
    """
    weights, names, schema = train(), docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = typed_scores(weights)
        for batch in batches:
            texts = [t and redact_text(t, weights, of) for t in batch.column(names.index("text")).to_pylist()]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names:
                was = batch.column(names.index("n_chars"))
                columns[names.index("n_chars")] = pa.array([w if t is None else len(t) for t, w in zip(texts, was.to_pylist())], was.type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(lean(run), schema)


def op2_semi_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
