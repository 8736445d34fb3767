"""Entries, scoring, corpora, mappings, streaming and the queries against their oracles."""

import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from mistveil.operators import entries as E
from mistveil.operators import scoring
from mistveil.plans import registry
from mistveil.sources import corpus, mappings
from mistveil.streaming import detection

from .test_pipeline_stages import entry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_oracles(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    got, want = registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    norm = lambda v: float("%.9g" % v) if isinstance(v, float) and not math.isnan(v) else v
    assert sorted(map(repr, ([norm(v) for v in r] for r in got.collect()))) == sorted(map(repr, ([norm(r[i]) for i in order] for r in want.fetchall())))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() >= 0


def test_masked_column_is_the_row_form(spark, sf):
    from mistveil.operators.masking import mask

    values = [("ab", "[x_1]"), ("abc", "[x_2]"), (".*", "[x_3]"), ("\\E", "[x_4]")]
    df = spark.createDataFrame([("abcab.*\\Eaab",)], "text string").withColumn("p", F.array(*[F.struct(F.lit(a).alias("text"), F.lit(b).alias("token")) for a, b in values]))
    assert df.select(mask(F.col("text"), F.col("p"))).first()[0] == "[x_2][x_1][x_3][x_4]a[x_1]"


@pytest.fixture
def table(spark):
    rows = [(1, f"e{i}", t, t, t, f"[人名_{i}]", "PERSON", None, None, None, ["regex"], None, [], True, i, "approved", i, None) for i, t in enumerate(["佐藤", "佐藤太郎", "鈴木", "田中"])]
    return spark.createDataFrame(rows, E.schema)


def test_groups(table):
    g = E.relate(table, ["e1", "e0"], "related-1-a").orderBy("id").collect()
    assert [r["token"] for r in g] == ["[人名_1]", "[人名_1]", "[人名_2]", "[人名_3]"] and g[0]["group_backup_token"] == "[人名_0]"
    grouped = E.relate(table, ["e1", "e0", "e2"], "related-1-a")
    assert [r["enabled"] for r in E.toggle(grouped, "e0").orderBy("id").collect()] == [False, False, False, True]
    assert [r["group_id"] for r in E.unlink(grouped, "e2").orderBy("id").collect()] == ["related-1-a", "related-1-a", None, None]
    two = E.relate(table, ["e1", "e0"], "related-1-a")
    assert E.unlink(two, "e0").where("group_id is not null").count() == 0
    assert sorted(map(tuple, E.unlink(two, group_id="related-1-a").select("id", "token").collect())) == sorted(map(tuple, table.select("id", "token").collect()))
    assert E.relate(table, ["e0"], "g").where("group_id is not null").count() == 0
    assert [r["number"] for r in E.group_numbers(E.relate(table, ["e1", "e0"], "related-4-a")).collect()] == [4]


def test_transitions(spark, table):
    items = spark.createDataFrame([(1, "佐藤", "ORGANIZATION", "[組織_1]", 9), (1, "新しい", "OTHER", "[その他_1]", 2), (1, " ", "OTHER", "[その他_2]", 2)], "doc_id long, text string, category string, token string, occurrence_count int")
    got = {r["normalized_text"]: r for r in E.add_manual(E.set_status(table, ["e0"], "unreviewed"), items).collect()}
    assert len(got) == 5 and got["佐藤"]["category"] == "ORGANIZATION" and got["佐藤"]["review_status"] == "approved" and "manual" in got["佐藤"]["sources"] and got["佐藤"]["token"] == "[人名_0]"
    assert got["新しい"]["display_order"] == 0 and got["新しい"]["token"] == "[その他_1]"
    docs = spark.createDataFrame([(1, "佐藤と佐藤太郎")], "doc_id long, text string")
    assert {r["normalized_text"]: r["occurrence_count"] for r in E.set_text(table, docs).collect()} == {"佐藤": 2, "佐藤太郎": 1, "鈴木": 0, "田中": 0}
    assert E.delete(table, ["e0", "e1"]).count() == 2
    rev = spark.createDataFrame([("a", 1), ("b", 1)], "text string, revision long")
    assert [r["revision"] for r in E.revised(rev, F.lit("a")).collect()] == [1, 2]


def test_numbers_skip_tokens_of_the_text(spark):
    df = spark.createDataFrame([(1, "PERSON", i, f"p{i}", "x [人名_1] [人名_3]") for i in range(3)], "doc_id long, category string, ord int, text string, source_text string")
    assert [r["token"] for r in E.number_tokens(df).orderBy("ord").collect()] == ["[人名_2]", "[人名_4]", "[人名_5]"]


def test_corpus_and_score(spark, tmp_path):
    path = tmp_path / "c.json"
    docs = [{"id": "a", "annotatedText": "x[[PERSON|佐藤]]と[[ADDRESS|東京]]"}, {"id": "b", "annotatedText": "none"}]
    path.write_text(json.dumps({"version": 1, "description": "", "documents": docs}))
    got = {r["doc_id"]: r for r in corpus.read(spark, str(path)).collect()}
    assert got["a"]["text"] == "x佐藤と東京" and [tuple(e) for e in got["a"]["entities"]] == [("PERSON", 1, 3, "佐藤"), ("ADDRESS", 4, 6, "東京")] and got["b"]["entities"] == []
    path.write_text(json.dumps({"version": 1, "description": "", "documents": docs + docs[:1]}))
    with pytest.raises(ValueError):
        corpus.read(spark, str(path))
    for bad in ("[[PERSON|]]", "[[NOPE|x]]", "[[PERSON|x"):
        with pytest.raises(Exception, match="bad annotation"):
            spark.createDataFrame([(bad,)], "t string").select(corpus.parse(F.col("t"))).collect()
    span = "doc_id string, category string, start int, end int, text string"
    e = spark.createDataFrame([("a", "PERSON", 0, 2, "佐藤"), ("a", "PERSON", 5, 7, "佐藤"), ("a", "ADDRESS", 9, 11, "東京")], span)
    p = spark.createDataFrame([("a", "PERSON", 0, 2, "佐藤"), ("a", "ORGANIZATION", 0, 2, "佐藤")], span)
    by = lambda mode: {r["category"]: (r["tp"], r["fp"], r["fn"]) for r in scoring.score(e, p, mode).collect()}
    assert by("occurrence") == {"PERSON": (1, 0, 1), "ADDRESS": (0, 0, 1), "ORGANIZATION": (0, 1, 0), None: (1, 1, 2)}
    assert by("target")["PERSON"] == (1, 0, 0) and [x.count() for x in scoring.errors(e, p, "target")] == [1, 1]


def saved(n=2):
    return mappings.create("name", mappings.snapshot([entry(f"t{i}", f"[その他_{i}]", id=f"i{i}") for i in range(n)]), now=1)


def test_mapping_forms():
    m = saved()
    assert mappings.validate(m) is m and mappings.fingerprint(m["entries"]) == mappings.fingerprint(m["entries"][::-1])
    assert [e["occurrence_count"] for e in mappings.reapply(m, "t0 t0 t1")] == [2, 1]
    again = mappings.create("name", m["entries"], m, now=5)
    assert (again["revision"], again["createdAt"], again["updatedAt"]) == (2, 1, 5)
    for change in ({"mode": "global"}, {"name": ""}, {"revision": 0}, {"entries": m["entries"] + m["entries"][:1]}):
        with pytest.raises(mappings.MappingError):
            mappings.validate(m | change)
    with pytest.raises(mappings.MappingError):
        mappings.snapshot([entry("a", "[x_1]", id="1", group_id="g")])
    assert mappings.LEAST <= mappings.calibrate(1) <= mappings.MOST


def test_store(spark, tmp_path):
    s, m, key = mappings.Store(spark, str(tmp_path)), saved(), "correct horse battery"
    s.save(m, key, 100_000)
    assert s.load(m["mappingId"], key) == m and s.list()[0]["status"] == "available"
    with pytest.raises(mappings.MappingError):
        s.save(m, key, 100_000)  # the revision does not follow
    with pytest.raises(mappings.MappingError):
        s.load(m["mappingId"], "another passphrase")
    file = next(tmp_path.glob("*.mapping"))
    sealed = json.loads(file.read_text())
    for change in ({"iterations": 100_001}, {"iv": sealed["salt"][:16]}):
        with pytest.raises(mappings.MappingError):
            mappings.decrypt(spark, sealed | change, key)
    (tmp_path / "index.json").write_text("{")
    assert s.inventory()["recovery"] and s.load(m["mappingId"], key) == m
    with pytest.raises(mappings.MappingError):
        s.save(mappings.create("n", m["entries"], m), key, 100_000)
    (tmp_path / "index.backup.json").unlink()
    with pytest.raises(mappings.MappingError, match="lost"):
        s.list()
    (tmp_path / "index.json").write_text(json.dumps({"version": 1, "mappings": []}))
    assert s.inventory()["unreferenced"] == 1
    file.unlink()
    s.delete()
    assert s.list() == []


@pytest.mark.parametrize("at", [None, "at"])
def test_streams(spark, tmp_path, at):
    rows = [("s", 1, "佐藤様です", "2026-01-01 10:00:00"), ("s", 2, "佐藤様と a@b.com", "2026-01-01 10:05:00")]
    spark.createDataFrame(rows, "session_id string, revision long, text string, at string").selectExpr("session_id", "revision", "text", "to_timestamp(at) as at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, revision long, text string, at timestamp").parquet(str(tmp_path / "in"))
    q = detection.session_dictionary(stream, at).writeStream.format("memory").queryName(f"sessions_{at}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    assert [(r["revision"], r["masked"]) for r in spark.table(f"sessions_{at}").orderBy("revision").collect()] == [(1, "[人名_1]です"), (2, "[人名_1]と [メール_1]")]
    assert detection.detect_stream(stream).isStreaming


def test_entry_point_imports_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=root, check=True, timeout=120)


def test_texts_in_and_out(spark, tmp_path):
    from mistveil.sources import texts

    rows = [(1, "か" + chr(0x3099) + " e" + chr(0x301)), (2, "plain"), (3, None), (4, "x" * 30_001)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "p"))
    got = {r["doc_id"]: r for r in texts.read(spark, str(tmp_path / "p")).collect()}
    assert got[1]["text"] == "が é" and got[3]["text"] is None and got[4]["is_long"] and not got[2]["is_long"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo")
    assert [r["text"] for r in texts.read(spark, str(tmp_path / "t"), "text").collect()] == ["one\ntwo"]
    masked = spark.createDataFrame([(1, "a", "a"), (2, "b", "[x_1]")], "doc_id long, text string, masked string")
    assert sorted(map(tuple, texts.write_masked(masked, str(tmp_path / "o")).collect())) == [(1, True), (2, False)]


def test_mappings_on_documents_and_results(spark, tmp_path, table):
    docs = spark.createDataFrame([(1, "t0 t0 t1"), (2, None)], "doc_id long, text string")
    got = E.from_docs(E.reapply(docs, saved())).orderBy("doc_id", "display_order").collect()
    assert [r["occurrence_count"] for r in got] == [2, 1, 0, 0]
    assert [r["number"] for r in E.next_group_number(E.relate(table, ["e1", "e0"], "related-4-a")).collect()] == [5]
    c = spark.createDataFrame([("a", "佐藤と東京", [("PERSON", 0, 2, "佐藤")])], "doc_id string, text string, entities array<struct<category:string,start:int,end:int,text:string>>")
    p = scoring.placed(c, spark.createDataFrame([("a", 0, "PERSON", "佐藤", None, None), ("a", 1, "EMAIL", "x", 0, 1)], "doc_id string, ord int, category string, text string, start int, end int"))
    s = scoring.evaluate(c, p)
    assert {r["category"]: r["f1"] for r in s.collect()} == {"PERSON": 1.0, None: 1.0}
    times = spark.createDataFrame([("detect", 1.0), ("detect", 4.0), ("detect", 2.0), ("mask", 1.0), ("mask", 2.0)], "operation string, ms double")
    scoring.write_result(s, c, str(tmp_path / "r"), times, run="test")
    assert spark.read.json(str(tmp_path / "r")).where("length(corpus_sha256) = 64 and run = 'test' and median_ms.detect = 2.0 and median_ms.mask = 1.5").count() == 2
    assert scoring.corpus_digest(c) != scoring.corpus_digest(c.limit(0))


def test_snapshots_are_in_japanese_order(spark, table):
    values = ["森", "あ", "ア", "a", "佐藤", "安藤", "か"]
    own = [entry(v, f"[人名_{i}]", id=f"i{i}") for i, v in enumerate(values)]
    want = ["a", "あ", "ア", "か", "安藤", "佐藤", "森"]
    assert [e["targetText"] for e in mappings.snapshot(own, spark)] == want and [e["targetText"] for e in mappings.snapshot(own)] != want
    rows = spark.createDataFrame([(1, f"i{i}", v, f"[人名_{i}]", v != "か", "approved") for i, v in enumerate(values)], "doc_id long, id string, normalized_text string, token string, enabled boolean, review_status string")
    assert [r["normalized_text"] for r in E.snapshot_order(rows).orderBy("snapshot_rank").collect()] == [v for v in want if v != "か"]


def test_places_are_looked_for_one_behind_the_other(spark):
    texts = spark.createDataFrame([(1, "佐藤と佐藤と東京")], "doc_id long, text string")
    rows = [(1, 0, "PERSON", "佐藤", None, None), (1, 1, "PERSON", "佐藤", None, None), (1, 2, "PERSON", "佐藤", None, None), (1, 3, "ADDRESS", "大阪", None, None), (1, 4, "ADDRESS", "東京", 6, 8)]
    got = scoring.placed(texts, spark.createDataFrame(rows, "doc_id long, ord int, category string, text string, start int, end int"))
    assert [(r["text"], r["start"], r["end"]) for r in got.collect()] == [("佐藤", 0, 2), ("佐藤", 3, 5), ("佐藤", 0, 2), ("東京", 6, 8)]
    assert [tuple(r) for r in scoring.distinct_counts(got).orderBy("category").collect()] == [("ADDRESS", 1, 1), ("PERSON", 1, 2)]


def test_documents_of_a_session(spark, table):
    schema = "doc_id long, text string, revision int, lock_reason string, response string, mapping string"
    docs = spark.createDataFrame([(i, "old", 3, "candidate_registered" if i == 4 else None, "", None) for i in range(1, 7)], schema)
    new = spark.createDataFrame([(1, "new", 3), (2, "new", 3), (3, "new", 2), (4, "new", 3), (5, "old", 3)], "doc_id long, text string, expected_revision int")
    got = {r["doc_id"]: (r["text"], r["revision"]) for r in E.apply_normalized(docs, new, table.withColumn("doc_id", F.lit(1).cast("long"))).collect()}
    assert got == {i: ("new", 4) if i == 2 else ("old", 3) for i in range(1, 7)}
    found = spark.createDataFrame([(1, "success", 0), (2, "failure", 2), (3, "failure", 0), (4, "success", 1), (5, None, 1)], "doc_id long, outcome string, candidates int")
    assert [r["lock_reason"] for r in E.complete_detection(docs, found).orderBy("doc_id").collect()] == ["detection_completed", "candidate_registered", None, "candidate_registered", "candidate_registered", None]
    answered = E.set_response(docs, spark.createDataFrame([(1, "か\u3099 x"), (2, " \u3000")], "doc_id long, response string"))
    assert [r["response"] for r in answered.orderBy("doc_id").collect()][:3] == ["\u304c x", " \u3000", ""]
    two = table.unionByName(table.withColumn("doc_id", F.lit(2).cast("long")))
    assert {r["doc_id"] for r in E.relate(two, ["e0", "e1"], "related-1-a", responses=answered).where("group_id is not null").select("doc_id").collect()} == {2}
    loaded = E.load_mapping(docs.drop("mapping"), saved()).first()
    assert loaded["lock_reason"] == "candidate_registered" and len(loaded["entries"]) == 2 and len(loaded["mapping"]["fingerprint"]) == 64
    assert tuple(E.clear(answered).first()) == (1, "", 0, None, "", None)


def test_maskable_counts(spark, table):
    docs = spark.createDataFrame([(1, "森さんは森林へ。佐藤と佐藤")], "doc_id long, text string")
    rows = table.limit(1).withColumn("original_text", F.lit("森")).withColumn("normalized_text", F.lit("森")).unionByName(table.limit(1))
    assert sorted((r["original_text"], r["maskable_count"]) for r in E.maskable(rows, docs).collect()) == [("佐藤", 2), ("森", 1)]
    assert {r["maskable_count"] for r in E.maskable(rows, docs, "all").collect()} == {2} and {r["maskable_count"] for r in E.maskable(rows.withColumn("enabled", F.lit(False)), docs).collect()} == {0}


def test_masking_keeps_private_characters(spark):
    from mistveil.operators.masking import mask

    df = spark.createDataFrame([("a\ue000b ab \ue001 ab",), ("\ue000\ue001\ufdd0\ufdd1 ab",)], "text string")
    pairs = F.array(F.struct(F.lit("ab").alias("text"), F.lit("[x_1]").alias("token")))
    assert [r[0] for r in df.select(mask(F.col("text"), pairs)).collect()] == ["a\ue000b [x_1] \ue001 [x_1]", "\ue000\ue001\ufdd0\ufdd1 [x_1]"]


def test_long_texts_survive_the_patterns(spark):
    """One domain of thousands of labels, and long runs of one character, pass through all detectors."""
    from mistveil.operators import pipeline, structured

    texts = ["a@b" + ".c" * 20_000 + ".jp x", "x" * 200_000, "a-" * 50_000, " " * 100_000, "1-" * 20_000, "!" * 50_000 + "a@b.jp"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: [x["text"] for x in r["x"]] for r in df.select("doc_id", structured.structured(F.col("text")).alias("x")).collect()}
    assert got[0] == [texts[0][:-2]] and got[1] == got[2] == got[3] == [] and len(got[5]) == 1 and got[5][0].endswith("a@b.jp")
    rows = {r["doc_id"]: [c["text"] for c in r["candidates"]] for r in pipeline.with_candidates(df).collect()}
    assert rows[0] == got[0]


def test_a_model_in_the_pipeline(spark):
    from mistveil.operators import ner

    def load():
        return lambda part: [{"entity_group": "PER", "word": "佐藤太郎", "start": part.find("佐藤太郎"), "end": part.find("佐藤太郎") + 4, "score": 0.9}] if "佐藤太郎" in part else []

    docs = spark.createDataFrame([(1, "本日は佐藤太郎が来て a@b.jp に書く"), (2, None)], "doc_id long, text string")
    got = {r["normalized_text"]: r for r in E.from_docs(ner.with_entries(docs, load)).collect()}
    assert set(got) == {"佐藤太郎", "a@b.jp"} and got["佐藤太郎"]["sources"] == ["ner"] and got["佐藤太郎"]["confidence"] == 0.9


def test_entries_in_the_row(spark):
    from mistveil.operators import structured

    text = "[メール_1] a@b.jp 10.0.0.1 a@b.jp c@d.jp 10.0.0.1 x"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(e) for e in r["e"]] for r in df.select("doc_id", E.in_row(F.col("text"), structured.structured(F.col("text"))).alias("e")).collect()}
    assert got[1] == [(0, "EMAIL", "a@b.jp", "[メール_2]", 2, 9), (2, "EMAIL", "c@d.jp", "[メール_3]", 1, 32), (3, "OTHER", "10.0.0.1", "[その他_1]", 2, 16)]
    assert got[2] == got[3] == []


def test_ranges_with_nulls_and_repeated_ones(spark, tmp_path):
    """As the SQL on one thread; on several it leaves the order of equal ranges open."""
    rows = [(i % 17000 if i % 3 else i % 17000 + 17000, i % 7) for i in range(300)] + [(i, i % 7) for i in range(120)] + [(None, 3), (None, 8), (None, 8), (5, None), (None, None)]
    spark.createDataFrame(rows, "event_id long, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = [tuple(r) for r in registry.queries()["range_coalesce"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(con.sql(registry.oracle_sql()["range_coalesce"]).fetchall(), key=str)
