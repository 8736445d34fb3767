"""Chats, vectors and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mistveil.llm import ann, chat, repetition


def brute_cost(roles):
    best = [1e9]

    def go(i, state, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            best[0] = min(best[0], cost + chat.END[state])
            return
        for s in (1, 2, 3):
            more = cost + (0 if roles[i] == s else chat.RELABEL)
            if state == s:
                go(i + 1, s, more + chat.MERGE)

            def fill(last, k):
                if s in chat._LEGAL[last]:
                    go(i + 1, s, more + k * chat.INSERT)
                if k < 3:
                    for x in chat._LEGAL[last]:
                        fill(x, k + 1)

            fill(state, 0)

    go(0, 0, 0.0)
    return best[0]


def path_cost(roles, states):
    cost, last = 0.0, 0
    for r, s in zip(roles, states):
        cost, last = cost + chat.STEP[r][last, s], s
    return cost + chat.END[last]


def test_repair_is_the_cheapest():
    rng = random.Random(1)
    for _ in range(60):
        roles = [rng.randrange(4) for _ in range(rng.randint(1, 5))]
        assert abs(path_cost(roles, chat.decode(np.array(roles), 0, None)) - brute_cost(roles)) < 1e-9


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_long_and_odd_conversations(spark, adaptive):
    """A conversation over several partitions is repaired at the same cost as in one piece, and renders as a legal one."""
    rng = random.Random(2)
    rows = [(1, i, rng.choice(["user", "assistant", "system", None, "tool"]), f"t{i}") for i in range(1500)]
    rows += [(2, 0, "assistant", "hi <|im_start|>x"), (None, 1, None, None), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, None, "user", ""), (5, 0, "user", "long " * 60_000)]
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = chat.repair(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as at", "2 as part")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    assert len(got) == len(rows)
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["seq"])
    assert [r["turn"] for r in one] == list(range(1500))
    roles = [chat._role(r[2]) for r in rows[:1500]]
    states = [chat.ROLES.index(r["new_role"]) + 1 for r in one]
    assert abs(path_cost(roles, states) - path_cost(roles, chat.decode(np.array(roles), 0, None))) < 1e-6
    for conv in (1, 2, 3, 4, 5, None):
        text = "".join(r["rendered"] for r in sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["seq"]))
        said = re.findall(r"<\|im_start\|>(\w+)\n", text)
        assert said[-1] == "assistant" and said.count("system") <= (said[0] == "system") and text.count("<|im_end|>") == len(said)
        assert all(a != b for a, b in zip(said, said[1:]))
    assert chat.repair(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_nearest(ids, x, top=20):
    out = {}
    for k, q in enumerate(ids):
        if q % 20 == 0:
            s = (x * x[k]).sum(axis=1)
            order = np.lexsort((ids, -s))
            out[q] = [(int(ids[i]), float(s[i])) for i in order if ids[i] != q][:top]
    return out


def test_search(spark, sf):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:200] = x[100]  # many equal vectors
    x[300:400] *= 5
    rows = [(i, x[i].tolist(), 0) for i in range(700)] + [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [1.0, None] * 8, 0), (1060, [float("nan")] * 16, 0), (1080, [float("inf")] * 16, 0), (1100, [1.0, 2.0], 0), (None, x[0].tolist(), 0)]
    got: dict = {}
    for r in ann.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(np.arange(700), x.astype(np.float64))
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and [f[1] for f in found] == [w[0] for w in want[q]]
        assert np.allclose([f[2] for f in found], [w[1] for w in want[q]])


def vectors_of(kind: str, n: int) -> np.ndarray:
    rng = np.random.default_rng(5)
    if kind == "spread":
        return rng.normal(size=(n, 32)).astype(np.float32)
    centres = rng.normal(size=(n // 100, 32)) * 3
    return (centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 32)) * 0.3).astype(np.float32)


@pytest.mark.parametrize("kind, n", [("spread", 2500), ("spread", 8000), ("clustered", 8000)])
def test_search_recall_when_cells_are_left_out(spark, monkeypatch, kind, n):
    """The learned share keeps the recall; the index prunes, and clustered vectors most of all."""
    shares = []
    needed = ann.needed_share
    monkeypatch.setattr(ann, "needed_share", lambda *a: shares.append(needed(*a)) or shares[-1])
    monkeypatch.setattr(ann, "PROBE", 100)
    x = vectors_of(kind, n)
    got = ann.search(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    want = brute_nearest(np.arange(n), x.astype(np.float64))
    hits = sum(r["vec_id"] in {w[0] for w in want[r["query_id"]]} for r in got)
    assert hits / sum(map(len, want.values())) >= 0.9 and len(got) == 20 * len(want)
    assert shares[0] < (0.1 if kind == "clustered" else 0.8)


def test_search_repeated_rows_and_doubles(spark):
    """A vec_id counts once however often it is there, and scores of doubles are those of doubles."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 8))
    rows = [(i, x[i].tolist()) for i in range(200)] + [(0, x[0].tolist())] * 30 + [(7, x[7].tolist())] * 5
    got = ann.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    want = brute_nearest(np.arange(200), x)
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(q, w[0]) for q in sorted(want) for w in want[q]]
    assert [r["rank"] for r in got if r["query_id"] == 0] == list(range(1, 21))
    assert np.allclose([r["score"] for r in got], [w[1] for q in sorted(want) for w in want[q]], rtol=1e-14, atol=0)


def test_walk_ends_where_strips_in_order_hold_enough():
    rng = np.random.default_rng(0)
    for t in range(200):
        k1, k2 = rng.integers(1, 40, 2)
        counts, d1, d2 = rng.integers(0, 4, (k2, k1)), rng.normal(size=k1), rng.normal(size=k2)
        if t % 2:
            d1, d2 = np.round(d1, 1), np.round(d2, 1)  # ties
        order = np.argsort(d2, kind="stable")
        strips = sorted((d2[order[j]] + d1[i], counts[order[j : j + ann.STRIP], i].sum()) for i in range(k1) for j in range(0, k2, ann.STRIP))
        for probe in (1, int(counts.sum()) // 3 + 1, int(counts.sum()), int(counts.sum()) + 1):
            held, end = 0, float("inf")
            for key, n in strips:
                held += n
                if held >= probe:
                    end = key
                    break
            assert ann.walk(d1, d2, counts, probe) == end


def test_search_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(spark, few).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]
    assert ann.search(spark, few.limit(0)).count() == 0


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_stages_against_plain_versions(spark, odd, sf, table):
    """Every stage's rows, each stage on what a plain version of the one before leaves."""
    import corpus_pipeline as c
    from mistveil.llm import mixing, packing, pii
    from tests.llm.test_documents import LOWER, WORD

    docs = (spark.read.parquet(f"{sf}/documents.parquet") if table == "documents" else odd).select(*c.COLUMNS)
    rows = [r.asDict() for r in docs.collect()]
    strip = lambda found: sorted((tuple(map(str, r.asDict().values())) for r in found.collect()))
    flat = lambda rows: sorted(tuple(map(str, r.values())) for r in rows)
    frame = lambda rows: spark.createDataFrame([tuple(r[c_] for c_ in docs.columns) for r in rows], docs.schema)

    def repeats(words, n):
        seen, dup = set(), [False] * len(words)
        for i in range(len(words) - n + 1):
            gram = tuple(words[i : i + n])
            if gram in seen:
                dup[i : i + n] = [True] * n
            seen.add(gram)
        return sum(len(w) for w, d in zip(words, dup) if d)

    def good(text):
        words = WORD.findall(text or "")
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        in_repeat = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        chars = sum(map(len, words))
        lines, dup_line = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dup_line += sum(map(len, WORD.findall(line))) if line in lines else 0
                lines.add(line)
        if len(words) < 50 or 2 * len(in_repeat) > len(words) or sum(x in "#*$%&|<>" for x in text) > repetition.SYMBOL_LIMIT * len(words):
            return False
        return dup_line <= repetition.LINE_LIMIT * chars and all(repeats(words, n) <= share * chars for n, share in repetition.NGRAM_LIMITS.items())

    want = [r for r in rows if good(r["text"])]
    assert strip(c.quality_rules(spark, docs, sf)) == flat(want) and want

    def shingles(text):
        w = WORD.findall((text or "").translate(LOWER))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    source = want if table == "documents" else rows
    ordered = sorted(source, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    sets, group = [shingles(r["text"]) for r in ordered], list(range(len(ordered)))
    root = lambda i: i if group[i] == i else root(group[i])
    for i in range(len(ordered)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    want = [r for i, r in enumerate(ordered) if root(i) == i]
    got = c.near_dedup(spark, frame(source), sf)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r["doc_id"]) for r in want) and len(want) < len(source)

    def redacted(r):
        text = r["text"]
        for s, e, k in reversed(_stretches(pii.all_spans(text or "", pii.train())[1])):
            text = text[:s] + f"[{pii.TYPES[k].upper()}]" + text[e:]
        return r | {"text": text, "n_chars": len(text) if text is not None else r["n_chars"]}

    source, want = want, [redacted(r) for r in want]
    assert strip(c.redact_pii(spark, frame(source), sf)) == flat(want)

    source = want
    size = Counter()
    for r in source:
        size[r["source"]] += len(r["text"] or "")
    present = {s: w for s, w in mixing.WEIGHTS.items() if size[s]}
    want = []
    for r in source:
        n = 1
        if r["source"] in present:
            rate = present[r["source"]] / sum(present.values()) * sum(size[s] for s in present) / size[r["source"]]
            name = str(r["doc_id"]) if r["doc_id"] is not None else "text:" + hashlib.md5((r["text"] or "").encode()).hexdigest()
            u = int(hashlib.md5(f"count:{mixing.SEED}:{name}".encode()).hexdigest()[:12], 16) / (1 << 48)
            n, p, total = 0, math.exp(-rate), math.exp(-rate)
            while total <= u and n < 200:
                n += 1
                p *= rate / n
                total += p
        want += [r] * n
    assert strip(c.mix_sources(spark, frame(source), sf)) == flat(want)

    encode = packing.encoder(*packing.default_tokenizer())
    got = c.pack_sequences(spark, frame(want), sf).collect()
    pieces = Counter()
    for r in want:
        ids = np.append(encode(r["text"] or ""), np.uint32(2)).astype("<u4")
        first = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            b = first if a == 0 else a + 1024
            pieces[r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert pieces == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    places: dict = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    assert len(places) <= 1.05 * -(-sum(r["length"] for r in got) // 1024) + 2


def _stretches(spans):
    out = []
    for s, e, k in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), out[-1][2])
        else:
            out.append((s, e, k))
    return out


def test_near_dedup_rows_without_or_with_shared_ids(spark):
    """Copies go whatever their ids are; different texts of one id both stay."""
    import corpus_pipeline as c

    text = [" ".join(f"w{i}x{k}" for i in range(80)) for k in range(3)]
    rows = [(None, text[0]), (None, text[0]), (3, text[0]), (4, text[1]), (4, text[2]), (4, text[1]), (None, text[2] + " end"), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in c.near_dedup(spark, docs, "").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(3, text[0]), (4, text[1]), (4, text[2]), (None, None), (7, "")]))


def test_pipeline(spark, odd, none, sf):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, sf)
        if k < len(c.STAGES) - 1:
            assert out.columns == c.COLUMNS
            assert 0 < out.count() and stage(spark, none, sf).count() == 0
            stage(spark, odd, sf).count()
            docs = out
    kept = c.quality_rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    one = c.near_dedup(spark, kept, sf)
    assert one.count() == one.select("doc_id").distinct().count() < kept.count()
    texts = {r["text"] for r in c.redact_pii(spark, one, sf).select("text").collect()}
    assert not any(re.search(r"[\w.]+@mail\d\.example\.com", t) for t in texts)
    assert c.run(spark, sf).count() > 0
