"""Saved dictionaries: snapshot, validation, encryption, and a store of versioned files.

Mappings are small and private, so they are handled on the driver. A passphrase or key never becomes a literal of a
plan: AES runs through Spark's function on a one-row table of binary columns.
"""

from __future__ import annotations

import base64
import contextlib
import fcntl
import gzip
import hashlib
import json
import os
import time
import unicodedata
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import nfc, trim
from ..functions.lexicon import CATEGORY_LABELS

MODE = "contextual"
MAX_ENTRIES, MAX_TEXT, MAX_NAME, MAX_TOKEN = 10_000, 100_000, 200, 200
_ERROR = "the mapping cannot be opened"


class MappingError(ValueError):
    pass


def snapshot(entries: list[dict], spark: SparkSession | None = None) -> list[dict]:
    """The active entries in saved form, by target, token and id; targets, tokens and ids must be unique, groups are refused.

    With a session, targets and tokens are in Japanese collation, otherwise in the order of code points.
    """
    own = [e for e in entries if e["enabled"] and e["review_status"] == "approved"]
    if any(e.get("group_id") for e in own):
        raise MappingError("grouped entries cannot be saved")
    out = [
        {"id": e["id"], "targetText": e["original_text"], "normalizedTargetText": nfc(e["normalized_text"]), "token": e["token"], "restorationText": e["restoration_text"], "category": e["category"], "sources": list(e["sources"]), "manual": "manual" in e["sources"]}
        for e in own
    ]
    check_unique(out)
    out.sort(key=lambda e: (e["normalizedTargetText"], e["token"], e["id"]))
    if spark is not None and out:  # at most MAX_ENTRIES rows
        rows = spark.createDataFrame([(i, e["normalizedTargetText"], e["token"], e["id"]) for i, e in enumerate(out)], "i int, target string, token string, id string")
        order = rows.orderBy(F.collate("target", "ja"), F.collate("token", "ja"), "id").select("i").collect()
        out = [out[r["i"]] for r in order]
    return out


def check_unique(entries: list[dict]) -> None:
    for key in ("normalizedTargetText", "token", "id"):
        if len({e[key] for e in entries}) < len(entries):
            raise MappingError(f"{key} is not unique")


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(entries: list[dict], mode: str = MODE) -> str:
    """The same for the same entries in any order."""
    return hashlib.sha256(canonical({"entries": sorted(entries, key=canonical), "mode": mode}).encode()).hexdigest()


def create(name: str, entries: list[dict], existing: dict | None = None, now: int | None = None) -> dict:
    now = now if now is not None else int(time.time() * 1000)
    return {"schemaVersion": 1, "mappingId": existing["mappingId"] if existing else str(uuid.uuid4()), "name": name, "createdAt": existing["createdAt"] if existing else now, "updatedAt": now, "revision": existing["revision"] + 1 if existing else 1, "mode": MODE, "entries": entries}


def validate(m: dict) -> dict:
    def need(ok: bool, what: str) -> None:
        if not ok:
            raise MappingError(what)

    need(isinstance(m, dict) and m.get("schemaVersion") == 1, "schemaVersion")
    need(isinstance(m.get("name"), str) and 0 < len(trim(m["name"])) and len(m["name"]) <= MAX_NAME, "name")
    need(m.get("mode") == MODE, "mode")
    for k in ("createdAt", "updatedAt", "revision"):
        need(type(m.get(k)) is int and 0 < m[k] < 1 << 53, k)
    need(isinstance(m.get("entries"), list) and len(m["entries"]) <= MAX_ENTRIES, "entries")
    for e in m["entries"]:
        need(all(isinstance(e.get(k), str) and e[k] and len(e[k]) <= MAX_TEXT for k in ("id", "targetText", "normalizedTargetText", "restorationText")), "text")
        need(isinstance(e.get("token"), str) and 0 < len(e["token"]) <= MAX_TOKEN and e.get("category") in CATEGORY_LABELS, "token or category")
        need(nfc(e["targetText"]) == e["normalizedTargetText"], "normalizedTargetText")
        need(isinstance(e.get("sources"), list) and e["sources"] and set(e["sources"]) <= {"regex", "ner", "manual"}, "sources")
        need(not e.get("relationId"), "grouped entries")
    check_unique(m["entries"])
    return m


def reapply(m: dict, text: str) -> list[dict]:
    """The saved entries as enabled, approved ones, counted on a new text."""
    text = nfc(text)
    return [
        {"id": e["id"], "original_text": e["targetText"], "normalized_text": e["normalizedTargetText"], "restoration_text": e["restorationText"], "token": e["token"], "category": e["category"], "sources": e["sources"], "confidence": None, "rules": [], "enabled": True, "occurrence_count": text.count(e["normalizedTargetText"]), "review_status": "approved", "display_order": i}
        for i, e in enumerate(m["entries"])
    ]


# Encryption -----------------------------------------------------------------------------

LEAST, MOST = 100_000, 2_000_000


def normalize_passphrase(p: str) -> str:
    p = unicodedata.normalize("NFKC", p)
    if len(p) < 12:
        raise MappingError("a passphrase has 12 characters at least")
    return p


def calibrate(target_ms: float = 350, sample: int = 20_000) -> int:
    """PBKDF2 rounds that take about the target, by ten thousands, within bounds."""
    t = time.perf_counter()
    hashlib.pbkdf2_hmac("sha256", b"calibrate", b"0" * 16, sample)
    rounds = sample * target_ms / max(1e-6, (time.perf_counter() - t) * 1000)
    return int(min(MOST, max(LEAST, round(rounds / 10_000) * 10_000)))


def _key(passphrase: str, salt: bytes, rounds: int) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", normalize_passphrase(passphrase).encode(), salt, rounds, 32)


def _aes(spark: SparkSession, name: str, **columns: bytes) -> bytes | None:
    row = spark.createDataFrame([tuple(bytearray(v) for v in columns.values())], ", ".join(f"{k} binary" for k in columns))
    f = F.aes_encrypt("data", "key", F.lit("GCM"), F.lit("DEFAULT"), "iv", "aad") if name == "encrypt" else F.try_aes_decrypt("data", "key", F.lit("GCM"), F.lit("DEFAULT"), "aad")
    value = row.select(f.alias("v")).first()["v"]
    return None if value is None else bytes(value)


def encrypt(spark: SparkSession, m: dict, passphrase: str, rounds: int = 200_000) -> dict:
    salt, iv = os.urandom(16), os.urandom(12)
    head = {"format": "mask-mapping", "formatVersion": 1, "kdf": "PBKDF2", "hash": "SHA-256", "iterations": rounds, "salt": base64.b64encode(salt).decode(), "encryption": "AES-GCM", "keyLength": 256, "tagLength": 128, "iv": base64.b64encode(iv).decode(), "compression": "gzip"}
    data = gzip.compress(canonical(m).encode(), mtime=0)
    sealed = _aes(spark, "encrypt", data=data, key=_key(passphrase, salt, rounds), iv=iv, aad=canonical(head).encode())
    return head | {"ciphertext": base64.b64encode(sealed[12:]).decode()}  # Spark puts the IV first


def decrypt(spark: SparkSession, envelope: dict, passphrase: str) -> dict:
    """The validated mapping; whatever is wrong, the error is the same."""
    try:
        head = {k: v for k, v in envelope.items() if k != "ciphertext"}
        if head.get("format") != "mask-mapping" or head.get("formatVersion") != 1 or not LEAST <= head["iterations"] <= MOST:
            raise MappingError(_ERROR)
        iv, salt = base64.b64decode(head["iv"], validate=True), base64.b64decode(head["salt"], validate=True)
        data = _aes(spark, "decrypt", data=iv + base64.b64decode(envelope["ciphertext"], validate=True), key=_key(passphrase, salt, head["iterations"]), aad=canonical(head).encode())
        return validate(json.loads(gzip.decompress(data)))
    except Exception as e:
        raise MappingError(_ERROR) from e


# Store ----------------------------------------------------------------------------------


class Store:
    """Encrypted mappings in a folder: a file for each revision, an index and its backup, one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    @contextlib.contextmanager
    def _lock(self):
        with (self.root / ".lock").open("w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def _write(self, name: str, value) -> None:
        part = self.root / f"{name}.{uuid.uuid4().hex}.tmp"
        part.write_text(canonical(value))
        if json.loads(part.read_text()) != value:
            raise MappingError("the file was not written as it is")
        os.replace(part, self.root / name)

    def _index(self) -> tuple[list[dict], bool]:
        """(rows, whether it may be written). The backup is read only; with neither but with files, it is refused."""
        for name, writable in (("index.json", True), ("index.backup.json", False)):
            with contextlib.suppress(OSError, ValueError, KeyError, TypeError):
                rows = json.loads((self.root / name).read_text())["mappings"]
                if all(set(r) == {"mappingId", "name", "fileName", "createdAt", "updatedAt", "revision"} for r in rows):
                    return rows, writable
        if list(self.root.glob("*.mapping")):
            raise MappingError("the index is lost")
        return [], True

    def _save_index(self, rows: list[dict], backup_first: bool = False) -> None:
        for name in ("index.backup.json", "index.json") if backup_first else ("index.json", "index.backup.json"):
            self._write(name, {"version": 1, "mappings": rows})

    def list(self) -> list[dict]:
        rows = [r | {"status": "available" if (self.root / r["fileName"]).exists() else "missing"} for r in self._index()[0]]
        return sorted(rows, key=lambda r: (-r["updatedAt"], r["mappingId"]))

    def table(self) -> DataFrame:
        """The same as rows of a DataFrame, with their place in the list."""
        rows = [(i, r["mappingId"], r["name"], r["fileName"], r["createdAt"], r["updatedAt"], r["revision"], r["status"]) for i, r in enumerate(self.list())]
        return self.spark.createDataFrame(rows, "place int, mapping_id string, name string, file_name string, created_at long, updated_at long, revision long, status string")

    def inventory(self) -> dict:
        files = {p.name for p in self.root.glob("*.mapping")}
        try:
            rows, writable = self._index()
        except MappingError:
            rows, writable = [], False
        return {"encrypted": len(files), "unreferenced": len(files - {r["fileName"] for r in rows}), "temporary": len(list(self.root.glob("*.tmp"))), "recovery": not writable, "writable": writable}

    def load(self, mapping_id: str, passphrase: str) -> dict:
        row = next((r for r in self._index()[0] if r["mappingId"] == mapping_id), None)
        if row is None:
            raise MappingError("not found")
        m = decrypt(self.spark, json.loads((self.root / row["fileName"]).read_text()), passphrase)
        if m["mappingId"] != mapping_id or m["revision"] != row["revision"]:
            raise MappingError("the file is not the one in the index")
        return m

    def save(self, m: dict, passphrase: str, rounds: int = 200_000) -> None:
        """Revisions follow each other; the file is read back and decrypted before the index names it."""
        validate(m)
        with self._lock():
            rows, writable = self._index()
            if not writable:
                raise MappingError("the index is read from its backup; nothing is written")
            was = next((r for r in rows if r["mappingId"] == m["mappingId"]), None)
            if m["revision"] != (was["revision"] + 1 if was else 1):
                raise MappingError("another revision was saved meanwhile")
            name = f"{m['mappingId']}-{m['revision']}.mapping"
            self._write(name, encrypt(self.spark, m, passphrase, rounds))
            if decrypt(self.spark, json.loads((self.root / name).read_text()), passphrase) != m:
                raise MappingError("the file cannot be read back")
            row = {"mappingId": m["mappingId"], "name": m["name"], "fileName": name, "createdAt": m["createdAt"], "updatedAt": m["updatedAt"], "revision": m["revision"]}
            self._save_index([r for r in rows if r is not was] + [row])

    def delete(self, mapping_id: str | None = None) -> None:
        """One mapping, or all; the backup forgets them before the files go. What is not there is no error."""
        with self._lock():
            rows, writable = self._index()
            if not writable:
                raise MappingError("the index is read from its backup; nothing is written")
            gone = [r for r in rows if mapping_id in (None, r["mappingId"])]
            self._save_index([r for r in rows if r not in gone], backup_first=True)
            for r in gone:
                (self.root / r["fileName"]).unlink(missing_ok=True)
