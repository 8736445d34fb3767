"""Golden sentences of the detectors, own text, and the Column forms against the forms in the row."""

import pytest

from mistveil.functions import lexicon
from mistveil.operators import names, normalize, pipeline, structured
from mistveil.operators.spans import spans, trim_spans


def texts(found):
    return [c.text for c in found]


@pytest.mark.parametrize(
    "detector, text, want",
    [
        (pipeline.emails, "宛先 a.b@ex-ample.co.jp、bad..x@e.com と .x@e.com と x@e.c1", ["a.b@ex-ample.co.jp"]),
        (pipeline.phones, "03-1234-5678 と 090 1234 5678、０９０－１２３４－５６７８、12-3456-7890、0123-456-78901", ["03-1234-5678", "090 1234 5678", "０９０－１２３４－５６７８"]),
        (pipeline.postal_codes, "〒100-0001 と 1234-5678、150ー0002", ["〒100-0001", "150ー0002"]),
        (pipeline.urls, "（https://example.com/a。）http://localhost/x と https://nohost", ["https://example.com/a", "http://localhost/x"]),
        (pipeline.ip_addresses, "10.0.0.1 256.1.1.1 01.2.3.4 fe80::1 12:30:45 1:2:3:4:5:6:7:8 ::1::2", ["10.0.0.1", "fe80::1", "1:2:3:4:5:6:7:8"]),
        (names.birth_dates, "生年月日：2000/02/29 誕生日は2001-02-29 DOB 1999.12.31 xDOB 1999.12.31", ["2000/02/29", "1999.12.31"]),
        (names.birth_dates, "生年月日「令和元年5月1日」生年月日「平成31年5月1日」", ["令和元年5月1日"]),
        (names.credentials, "ユーザーID「test.user」、パスワード「Tmp-2026!」です", ["test.user", "Tmp-2026!"]),
        (names.addresses, "所在地：大阪府大阪市北区梅田1丁目2番3号 梅田ビル、市区町村だけ", ["大阪府大阪市北区梅田1丁目2番3号 梅田ビル"]),
        (names.titled_names, "佐藤様、次に曽我部部長が、仕様は", ["佐藤様", "曽我部部長"]),
        (names.person_names, "担当は 田中 太郎 です", ["田中 太郎"]),
        (names.person_names, "- 林\n- 山本花子\n山本製作所", ["林", "山本花子"]),
        (names.person_names, "姓：髙橋 名義人 JOHN SMITH さん", ["髙橋", "JOHN SMITH"]),
        (names.person_names, "株式会社の小林一郎が", ["小林一郎"]),
    ],
)
def test_golden(detector, text, want):
    found = detector(text)
    for w in want:
        assert w in texts(found), (w, texts(found))
    assert all(text[c.start : c.end] == c.text for c in found)
    if detector is not names.person_names:
        assert sorted(texts(found)) == sorted(want)


def test_structured_containers():
    text = "name: John Smith\n\n| 氏名 | 備考 |\n|:---|---|\n| 鈴木 一郎 | 田中花子 |\n| 伊藤\\|次郎 | x |\n\n```json\n{\"担当\": \"加藤三郎\", \"other\": \"高橋四郎\"}\n```\n```json\n{bad \"担当\": \"中村五郎\"}\n```\n```tsv\n担当者\tx\n小林六郎\t1\n```\n"
    got = texts(names.structured_names(text))
    assert got == ["John Smith", "鈴木 一郎", "加藤三郎", "小林六郎"]


def test_normalization_keeps_the_way_back():
    text = "メール： ｓａｔｏ＠example.com 電話090-\n1234-5678 https://example.com/a/\nb 佐 藤 太 郎 。"
    for c in pipeline.detect(text):
        assert text[c.start : c.end] == c.text
        if c.restoration:
            assert [x for x in c.restoration] == [x for x in normalize.fold_fullwidth(c.text) if not x.isspace()]
    got = {c.restoration: c.rules for c in pipeline.detect(text) if c.restoration}
    assert got["sato@example.com"] == ("fullwidth_ascii",) and got["090-1234-5678"] == ("phone_line_break",) and got["https://example.com/a/b"] == ("url_line_break",)
    assert got["佐藤太郎"] == ("japanese_inter_character_space",)


def test_fences_and_headings_are_left_alone():
    assert normalize.broken_organizations("```\n株式会社\nテスト\n```") == []
    assert [c.restoration for c in normalize.broken_organizations("取引先は\n株式会社\nテスト。")] == ["株式会社テスト"] or normalize.broken_organizations("(株式会社\nテスト)")


def test_column_forms_are_the_row_forms(spark):
    rows = ["a.b@ex.com, 10.0.0.1; 03-1234-5678 〒100-0001 https://a.example/x?y=1.", "", "x@e.com fe80::1", "𠮷 t@e.jp 𠮷", "(1.2.3.4) 'q@e.org'"]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    for column, detector in ((structured.emails, pipeline.emails), (structured.phones, pipeline.phones), (structured.postal_codes, pipeline.postal_codes), (structured.urls, pipeline.urls), (structured.ip_addresses, pipeline.ip_addresses)):
        for r in df.select("text", column(df["text"]).alias("x")).collect():
            assert [(x["text"], x["start"], x["end"]) for x in r["x"]] == [(c.text, c.start, c.end) for c in detector(r["text"])]


def test_spans_of_nulls_and_edges(spark):
    df = spark.createDataFrame([(None,), ("",), ("「a」",)], "text string")
    got = [r["x"] for r in df.select(trim_spans(spans(df["text"], "()(「.」)")).alias("x")).collect()]
    assert got[0] == [] and got[1] == [] and [(x["start"], x["end"], x["text"]) for x in got[2]] == [(1, 2, "a")]


def test_surnames_are_a_parameter():
    was = lexicon.surnames()
    try:
        lexicon.set_surnames(["勅使河原"])
        assert texts(names.person_names("担当は 勅使河原 太郎 です")) == ["勅使河原 太郎"]
        assert names.person_names("担当は 田中 太郎 です") == []
    finally:
        lexicon.set_surnames(was)
