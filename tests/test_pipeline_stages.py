"""The stages behind the detectors, entries, masking, context, restoring, documents, NER."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mistveil.functions.lexicon import COMMON_WORDS
from mistveil.operators import docnorm, masking, ner, pipeline
from mistveil.operators.candidates import Candidate


def entry(text, token, category="OTHER", **more):
    return {"original_text": text, "normalized_text": text, "restoration_text": text, "token": token, "category": category, "sources": ["regex"], "confidence": None, "rules": [], "enabled": True, "occurrence_count": 1, "review_status": "approved", "display_order": 0} | more


def test_enrich_adds_standalone_surnames_and_readings():
    text = "佐藤太郎が来た。佐藤は帰る。\n鈴木一郎すずきいちろう\n"
    got = [c.text for c in pipeline.enrich(text, [Candidate("佐藤太郎", "PERSON", start=0, end=4)])]
    assert got == ["佐藤太郎", "鈴木一郎", "佐藤"]


def test_enrich_finds_spaced_spellings_of_model_names():
    got = pipeline.enrich("佐藤 太郎です", [Candidate("佐藤太郎", "PERSON", "ner")])
    assert [(c.text, c.restoration) for c in got[1:]] == [("佐藤 太郎", "佐藤太郎")]


def test_refine_drops_fragments():
    text = "045 123-4567 と info@example.com の exampleさん 3階"
    found = pipeline.phones(text) + pipeline.emails(text) + [Candidate("123-4567", "POSTAL_CODE", start=4, end=12), Candidate("info", "PERSON", "ner", 15, 19), Candidate("3階", "ADDRESS", "ner", 41, 43)]
    assert [c.text for c in pipeline.refine(text, found)] == ["045 123-4567", "info@example.com"]


def test_titles_are_added_where_the_place_is_certain():
    got = pipeline.extend_titles("田中部長と田中", [Candidate("田中", "PERSON", start=0, end=2), Candidate("田中", "PERSON")])
    assert [c.text for c in got] == ["田中部長", "田中"]


def test_merge_keeps_the_first_category_and_prefers_regex_spelling():
    text = "佐 藤 と [人名_1]"
    a, b = Candidate("佐 藤", "PERSON", "ner", confidence=0.4, restoration="佐　藤"), Candidate("佐 藤", "ORGANIZATION", "regex", restoration="佐藤", confidence=0.2)
    for order in itertools.permutations([a, b]):
        (e,) = pipeline.merge(text, [], list(order))
        assert e["category"] == order[0].category and e["confidence"] == 0.4 and e["restoration_text"] == "佐藤" and sorted(e["sources"]) == ["ner", "regex"]
    assert pipeline.merge(text, [], [a])[0]["token"] == "[人名_2]"
    off = pipeline.merge(text, [entry("佐 藤", "[人名_5]", enabled=False)], [a])
    assert off[0]["enabled"] is False
    assert pipeline.merge(text, [], [Candidate(" ", "PERSON"), Candidate("無い", "PERSON")]) == []


def test_mask_is_longest_first_in_one_scan():
    es = [entry("山田", "[A_1]"), entry("山田太郎", "[A_2]"), entry("A_2", "[A_3]")]
    assert masking.mask_text("山田太郎と山田とA_2", es) == "[A_2]と[A_1]と[A_3]"
    assert masking.mask_text("ＡaA", [entry("a", "[x_1]")]) == "Ａ[x_1]A"


@given(st.text("ab[_1]x", max_size=30), st.lists(st.text("abx", min_size=1, max_size=3), unique=True, max_size=4))
@settings(max_examples=150, deadline=None)
def test_restore_undoes_mask(text, values):
    """As long as no token is in the text or in a value."""
    es = [entry(v, f"[値_{i}]") for i, v in enumerate(values)]
    masked = masking.mask_text(text, es)
    assert masking.restore_text(masked, es) == text
    spans = [s for s in masking.segments(text, es)]
    assert "".join(s["value"] for s in spans) == text and all(a["end"] == b["start"] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("name, phrase", [(n, p) for n, ps in COMMON_WORDS.items() for p in ps])
def test_common_words_are_not_masked(name, phrase):
    e = entry(name, "[人名_1]", "PERSON")
    assert masking.mask_text(f"これは{phrase}です", [e]) == f"これは{phrase}です"
    assert masking.mask_text(f"担当：{name}", [e]) == "担当：[人名_1]"
    assert masking.mask_text(f"{name}様", [e]) == "[人名_1]様"
    assert masking.maskable_count(f"{phrase}、{name}様", e) == 1


def test_inspect_and_cascade():
    es = [entry("佐藤", "[人名_1]"), entry("x", "[人名_10]", restoration_text="[人名_1]")]
    assert masking.restore_text("[人名_10]", es) == "佐藤"
    got = masking.inspect_text("[人名_1] [人名_3] 佐藤", es, "[人名_1]")
    assert got == {"known_present": ["[人名_1]"], "absent": ["[人名_10]"], "unknown": ["[人名_3]"], "natural": ["佐藤"]}


@pytest.mark.parametrize("mode", ["standard", "detection_priority"])
@pytest.mark.parametrize("text", ["氏名：\n山田　太郎\r\nＡ​\n\n\n\nb  c", "・一つ目\n続き\n・二つ目", "```\na  b\n```\n    code  x\nplain  y", "電話 090 - 1234\n- 5678 〒100 -\n0001 2024 年 1 月 2 日 12 ： 30", "a @\nexample . com", "-" * 5000 + "@" + "." * 500, "", "が"])
def test_document_normalization_is_idempotent(text, mode):
    r = docnorm.normalize_document(text, mode)
    assert docnorm.normalize_document(r["normalized_text"], mode)["normalized_text"] == r["normalized_text"]
    assert len(r["mappings"]) == len(r["normalized_text"])
    before, after = docnorm.preview(text, r)
    assert "".join(x["text"] for x in before) == text and "".join(x["text"] for x in after) == r["normalized_text"]


def test_document_rules():
    r = docnorm.normalize_document("電話 090 - 1234\n- 5678、2023 年 2 月 30 日")
    assert r["normalized_text"] == "電話 090-1234-5678、2023 年 2 月 30 日"
    assert {"rule_id": "phone_line_break", "kind": "line_break", "count": 1} in r["summary"] and r["changed_location_count"] == 1
    assert docnorm.normalize_document("これは\n文です", "detection_priority")["normalized_text"] == "これは文です"


@given(st.text("あ。\n𠮷x", max_size=200), st.integers(2, 40), st.integers(0, 39))
@settings(max_examples=150, deadline=None)
def test_chunks_cover_the_text(text, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            ner.chunks(text, size, overlap)
        return
    got = ner.chunks(text, size, overlap)
    assert all(p == text[a:b] and b - a <= size for a, b, p in got)
    assert not text or got[0][0] == 0 and got[-1][1] == len(text) and all(x[1] >= y[0] for x, y in zip(got, got[1:]))


def test_ner_with_a_stub():
    def classify(part):
        return [{"entity_group": "PER", "word": w, "start": part.find(w), "end": part.find(w) + 2, "score": 0.9} for w in ("佐藤",) if w in part] + [{"entity": "B-ORG", "word": "▁ab"}, {"entity": "X", "word": "佐藤"}]

    text = "あ" * 310 + "佐藤。" + "い" * 100
    got = ner.run_chunked(text, classify)
    assert [] == [c for c in got if c.category == "ORGANIZATION"]
    spaced = ner.run_normalized("氏名：佐 藤 太 郎 。", lambda p: [{"entity_group": "PER", "word": "佐藤太郎", "start": p.find("佐藤太郎"), "end": p.find("佐藤太郎") + 4, "score": 0.5}] if "佐藤太郎" in p else [])
    assert [(c.text, c.restoration) for c in spaced] == [("佐 藤 太 郎", "佐藤太郎")]
