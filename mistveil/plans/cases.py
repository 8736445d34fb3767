"""Queries over generated Japanese texts and sessions, with what they have to return in SQL.

A case of a detector is a text made of a customer's key, the function that looks at it, and the candidates that it has
to find, written as expressions of the same key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import docnorm, entries as E, masking as M, ner, pipeline as P, scoring
from ..operators import names as N
from ..operators.spans import occurrences, strictly_contained
from ..operators import structured as S
from ..sources import corpus

_K = "CAST(c_custkey AS STRING)"
_FULL = "CASE c_custkey % 3 WHEN 0 THEN '佐藤 花子' WHEN 1 THEN '高橋 一郎' ELSE '渡辺 太郎' END"
_COMPACT = "CASE c_custkey % 3 WHEN 0 THEN '佐藤花子' WHEN 1 THEN '高橋一郎' ELSE '渡辺太郎' END"
_SURNAME = "CASE c_custkey % 3 WHEN 0 THEN '佐藤' WHEN 1 THEN '高橋' ELSE '渡辺' END"
_GIVEN = "CASE c_custkey % 3 WHEN 0 THEN '花子' WHEN 1 THEN '一郎' ELSE '太郎' END"
_ENGLISH = "CASE c_custkey % 3 WHEN 0 THEN 'Hanako Sato' WHEN 1 THEN 'Ichiro Takahashi' ELSE 'Taro Watanabe' END"
_FOUR = "lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')"
_NL = "chr(10)"

#: name: (text, function, [(category, value)])
DETECTED = {
    "names_key_value": (f"concat('担当：', {_FULL})", N.structured_names, [("PERSON", _FULL)]),
    "names_markdown_table": (f"concat('| 氏名 | 番号 |', {_NL}, '| --- | --- |', {_NL}, '| ', {_FULL}, ' | ', {_K}, ' |', {_NL})", N.structured_names, [("PERSON", _FULL)]),
    "names_csv_fence": (f"concat('```csv', {_NL}, 'id,name', {_NL}, {_K}, ',', {_FULL}, {_NL}, '```')", N.structured_names, [("PERSON", _FULL)]),
    "names_tsv_fence": (f"concat('```tsv', {_NL}, 'name', chr(9), 'id', {_NL}, {_FULL}, chr(9), {_K}, {_NL}, '```')", N.structured_names, [("PERSON", _FULL)]),
    "names_json_fence": (f"concat('```json', {_NL}, '{{\"owner\": \"', {_FULL}, '\", \"id\": ', {_K}, '}}', {_NL}, '```')", N.structured_names, [("PERSON", _FULL)]),
    "person_alone": (f"concat('本日、', {_COMPACT}, '、着')", N.person_names, [("PERSON", _COMPACT)]),
    "person_listed": (f"concat('- ', {_COMPACT}, {_NL}, '・森', {_NL})", N.person_names, [("PERSON", _COMPACT), ("PERSON", "'森'")]),
    "person_spaced": (f"concat('今日は', {_FULL}, 'さんが来る')", N.person_names, [("PERSON", _FULL)]),
    "person_contextual": (f"concat('営業部の', {_FULL}, 'です')", N.person_names, [("PERSON", _FULL)]),
    "person_possessive": (f"concat('青葉テクノロジーの', {_COMPACT}, 'は')", N.person_names, [("PERSON", _COMPACT)]),
    "person_labelled_surname": ("concat('氏名：森、番号', CAST(c_custkey AS STRING))", N.person_names, [("PERSON", "'森'")]),
    "person_surname_label": (f"concat('姓：', {_SURNAME}, '、')", N.person_names, [("PERSON", _SURNAME)]),
    "person_english": (f"concat('口座名義: ', {_ENGLISH}, '、')", N.person_names, [("PERSON", _ENGLISH)]),
    "birth_date_era": ("concat('生年月日：昭和', CAST(20 + c_custkey % 40 AS STRING), '年', CAST(1 + c_custkey % 12 AS STRING), '月', CAST(1 + c_custkey % 28 AS STRING), '日')", N.birth_dates, [("OTHER", "concat('昭和', CAST(20 + c_custkey % 40 AS STRING), '年', CAST(1 + c_custkey % 12 AS STRING), '月', CAST(1 + c_custkey % 28 AS STRING), '日')")]),
    "detect_ipv6": (f"concat('接続は 2001:db8::', {_FOUR}, ' です')", P.ip_addresses, [("OTHER", f"concat('2001:db8::', {_FOUR})")]),
    "email_over_lines": (f"concat('連絡は user', {_K}, '@', {_NL}, 'example.test まで')", P.detect, [("EMAIL", f"concat('user', {_K}, '@', {_NL}, 'example.test')")]),
    "email_spaced": (f"concat('user', {_K}, ' ＠ example.test')", P.detect, [("EMAIL", f"concat('user', {_K}, ' ＠ example.test')")]),
    "url_over_lines": (f"concat('見る https://example.test/a', {_NL}, '/b?x=', {_K}, ' です')", P.detect, [("OTHER", f"concat('https://example.test/a', {_NL}, '/b?x=', {_K})")]),
    "phone_over_lines": (f"concat('電話 ０９０-1234-', {_NL}, {_FOUR}, ' です')", P.detect, [("PHONE", f"concat('０９０-1234-', {_NL}, {_FOUR})")]),
    "organization_over_lines": (f"concat('株式会社', {_NL}, '青葉システム の件', {_K})", P.detect, [("ORGANIZATION", f"concat('株式会社', {_NL}, '青葉システム')")]),
    "address_over_lines": (f"concat('住所：東京都千代田区', {_NL}, '丸の内1-2-', CAST(1 + c_custkey % 9 AS STRING))", P.detect, [("ADDRESS", f"concat('東京都千代田区', {_NL}, '丸の内1-2-', CAST(1 + c_custkey % 9 AS STRING))")]),
    "surnames_alone": (f"concat('担当は', {_FULL}, 'です。', {_NL}, {_SURNAME}, 'は帰る')", P.all_candidates, [("PERSON", _FULL), ("PERSON", _SURNAME)]),
    "titles_extended": (f"concat('氏名：', {_FULL}, '様')", P.all_candidates, [("PERSON", f"concat({_FULL}, '様')")]),
}

# The text in which one-character surnames are people and parts of common words, and its entries' tokens
_MIXED = f"concat('氏名：', {_FULL}, {_NL}, '森さんは森林へ行く。電話090-0012-', {_FOUR}, ' まで')"


def _text(name: str, text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("doc_id"), F.expr(text).alias("text"))

    return run


def _detected(name: str):
    text, detector, _ = DETECTED[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = P.exploded(P.with_candidates(_text(name, text)(spark, sf_dir), detector))
        return found.select("doc_id", "category", F.col("text").alias("value")).distinct()

    return run


def _sql(expression: str) -> str:
    return expression.replace("AS STRING", "AS VARCHAR")


def _detected_sql(name: str) -> str:
    return " UNION ".join(f"SELECT CAST(c_custkey AS BIGINT) AS doc_id, '{c}' AS category, {_sql(v)} AS value FROM customer" for c, v in DETECTED[name][2])


# Masks and segments ------------------------------------------------------------------------


def masked_in_context(spark, sf_dir):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: M.mask_text(t, P.merge(t, [], P.all_candidates(t))))

    return _text("", _MIXED)(spark, sf_dir).select("doc_id", run("text").alias("masked"))


def segments_in_context(spark, sf_dir):
    @F.pandas_udf("array<struct<value:string,start:int,end:int,token:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{k: s[k] for k in ("value", "start", "end", "token")} for s in M.segments(t, P.merge(t, [], P.all_candidates(t)), everything=True)])

    return _text("", _MIXED)(spark, sf_dir).select("doc_id", F.explode(P.once(run)("text")).alias("s")).select("doc_id", "s.*")


_SEGMENTS = f"""SELECT CAST(c_custkey AS BIGINT) AS doc_id, unnest([
  {{'value': '氏名：', 'start': 0, 'end': 3, 'token': NULL}}, {{'value': {_sql(_FULL)}, 'start': 3, 'end': 8, 'token': '[人名_2]'}}, {{'value': chr(10), 'start': 8, 'end': 9, 'token': NULL}},
  {{'value': '森さん', 'start': 9, 'end': 12, 'token': '[人名_1]'}}, {{'value': 'は森林へ行く。電話', 'start': 12, 'end': 21, 'token': NULL}},
  {{'value': concat('090-0012-', {_sql(_FOUR)}), 'start': 21, 'end': 34, 'token': '[電話_1]'}}, {{'value': ' まで', 'start': 34, 'end': 37, 'token': NULL}}]) AS s FROM customer"""


def _normalized(text: str, mode: str = "standard"):
    def run(spark, sf_dir):
        @F.pandas_udf("struct<value:string,changed:int>")
        def own(texts: pd.Series) -> pd.DataFrame:
            found = [docnorm.normalize_document(t, mode, mappings=False) for t in texts]
            return pd.DataFrame({"value": [r["normalized_text"] for r in found], "changed": [r["changed_location_count"] for r in found]})

        return _text("", text)(spark, sf_dir).select("doc_id", own("text").alias("r")).select("doc_id", "r.*")

    return run


#: name: (text, normalized, changed locations)
NORMALIZED = {
    "line_endings": (f"concat('a', {_K}, chr(13), chr(10), 'b', chr(13), 'c', chr(10), 'd')", f"concat('a', {_K}, chr(10), 'b', chr(10), 'c', chr(10), 'd')", 2),
    "blank_runs": (f"concat('a  b', chr(9), chr(9), {_K}, '   d', chr(10), chr(10), chr(10), chr(10), 'e')", f"concat('a b ', {_K}, ' d', chr(10), chr(10), 'e')", 4),
    "invisible_characters": (f"concat('a{chr(0x200B)}', {_K}, '{chr(0xFEFF)}b{chr(0xA0)}c')", f"concat('a', {_K}, 'b c')", 3),
    "document_fullwidth": (f"concat('ＡＢＣ', {_K}, '！')", f"concat('ABC', {_K}, '!')", 2),
    "document_email": (f"concat('taro.', chr(10), 'y', {_K}, '@', chr(10), 'example.', chr(10), 'jp', chr(10), '次の行')", f"concat('taro.y', {_K}, '@example.jp', chr(10), '次の行')", 1),
    "document_phone": (f"concat('電話 090 - 1234', chr(10), '- ', {_FOUR}, '、')", f"concat('電話 090-1234-', {_FOUR}, '、')", 1),
    "document_label": (f"concat('氏名：', chr(10), '山田 太郎', {_K}, chr(10), 'これは別の文章です。')", f"concat('氏名:山田 太郎', {_K}, chr(10), 'これは別の文章です。')", 1),
    "document_date": ("concat('2024 年 2 月 ', CAST(1 + c_custkey % 29 AS STRING), ' 日と 2023 年 2 月 30 日')", "concat('2024年2月', CAST(1 + c_custkey % 29 AS STRING), '日と 2023 年 2 月 30 日')", 1),
}


# Sessions ------------------------------------------------------------------------------------


def _session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of 25 documents: states, categories and groups follow the key."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("v"), k)
    none = F.lit(None).cast("string")
    grouped = (k % 6 == 0) & (k % 5 != 0)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_nationkey").cast("long").alias("doc_id"), F.concat(F.lit("e"), k).alias("id"), text.alias("original_text"), text.alias("normalized_text"), text.alias("restoration_text"),
        F.when(grouped, F.lit("[人名_1]")).otherwise(F.concat(F.lit("[人名_"), k, F.lit("]"))).alias("token"), F.when(k % 4 == 0, "ORGANIZATION").otherwise("PERSON").alias("category"),
        F.when(grouped, F.concat(F.lit("related-"), F.col("c_nationkey") + 1, F.lit("-x"))).alias("group_id"), F.when(grouped, text).otherwise(none).alias("group_backup_restoration"),
        F.when(grouped, F.concat(F.lit("[人名_"), k, F.lit("]"))).otherwise(none).alias("group_backup_token"), F.when(k % 7 == 0, F.array(F.lit("manual"))).otherwise(F.array(F.lit("regex"))).alias("sources"),
        F.lit(None).cast("double").alias("confidence"), F.array().cast("array<string>").alias("rules"), (k % 5 != 0).alias("enabled"), (k % 3).cast("int").alias("occurrence_count"),
        F.when(k % 8 == 1, "unreviewed").otherwise("approved").alias("review_status"), k.cast("int").alias("display_order"), none.cast("long").alias("promoted_at"),
    )


_SESSION = """s AS (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, c_custkey AS k, concat('e', c_custkey) AS id, concat('v', c_custkey) AS t, c_custkey % 6 = 0 AND c_custkey % 5 <> 0 AS grouped,
  CASE WHEN c_custkey % 6 = 0 AND c_custkey % 5 <> 0 THEN concat('related-', c_nationkey + 1, '-x') END AS group_id, CASE WHEN c_custkey % 6 = 0 AND c_custkey % 5 <> 0 THEN '[人名_1]' ELSE concat('[人名_', c_custkey, ']') END AS token,
  c_custkey % 5 <> 0 AS enabled, CASE WHEN c_custkey % 8 = 1 THEN 'unreviewed' ELSE 'approved' END AS review_status, CASE WHEN c_custkey % 4 = 0 THEN 'ORGANIZATION' ELSE 'PERSON' END AS category FROM customer)"""
_IDS = [f"e{i}" for i in range(1, 40)]
_IN = "id IN (" + ", ".join(f"'{i}'" for i in _IDS) + ")"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, "").when(k % 5 == 1, F.lit("　\t\n ")).otherwise(F.concat(F.lit("text "), k, F.lit(" v"), k % 4, F.lit(" v"), k % 4))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.cast("long").alias("doc_id"), text.alias("text"), (k % 3).cast("int").alias("revision"), F.when(k % 7 == 0, "candidate_registered").alias("lock_reason"), F.when(k % 4 == 0, "answer").otherwise(" ").alias("response"),
        F.lit(None).cast("string").alias("mapping"), (k % 7 == 0).alias("locked"), (k % 11 == 0).alias("detecting"), (k % 13 == 0).alias("normalizing"),
    )


_DOCUMENTS = """d AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat(chr(12288), chr(9), chr(10), ' ') ELSE concat('text ', c_custkey, ' v', c_custkey % 4, ' v', c_custkey % 4) END AS text,
  CAST(c_custkey % 3 AS INT) AS revision, CASE WHEN c_custkey % 7 = 0 THEN 'candidate_registered' END AS lock_reason, CASE WHEN c_custkey % 4 = 0 THEN 'answer' ELSE ' ' END AS response FROM customer)"""


def availability(spark, sf_dir):
    return E.availability(_documents(spark, sf_dir)).select("doc_id", "availability")


def apply_normalized(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    proposals = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("が"))).alias("text"), (F.col("doc_id") % 4 % 3).cast("int").alias("expected_revision"))
    used = docs.where("doc_id % 9 = 0").select("doc_id")
    return E.apply_normalized(docs, proposals, used).select("doc_id", "text", "revision")


def complete_detection(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    found = docs.where("doc_id % 10 < 8").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "success").when(F.col("doc_id") % 3 == 1, "failure").alias("outcome"), (F.col("doc_id") % 2).cast("int").alias("candidates"))
    return E.complete_detection(docs, found).select("doc_id", "lock_reason")


def set_response(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return E.set_response(docs, docs.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("が"), "doc_id").alias("response"))).select("doc_id", "response")


def clear_session(spark, sf_dir):
    return E.clear(_documents(spark, sf_dir)).select("doc_id", "text", "revision", "lock_reason", "response")


def set_text(spark, sf_dir):
    docs = _documents(spark, sf_dir).withColumn("text", F.concat(F.lit("v"), F.col("doc_id") * 3, F.lit(" v"), F.col("doc_id") * 3, "text"))
    return E.set_text(_session(spark, sf_dir), docs).select("doc_id", "id", "occurrence_count")


def delete_entries(spark, sf_dir):
    return E.delete(_session(spark, sf_dir), _IDS).select("doc_id", "id")


def review_status(spark, sf_dir):
    return E.set_status(_session(spark, sf_dir), _IDS, "rejected").select("doc_id", "id", "review_status")


def toggle_group(spark, sf_dir):
    """Of e6, and of all entries of its group."""
    return E.toggle(_session(spark, sf_dir), "e6").select("doc_id", "id", "enabled")


def unlink_groups(spark, sf_dir):
    return E.unlink(_session(spark, sf_dir), group_id="related-3-x").select("doc_id", "id", "token", "group_id")


def relate_people(spark, sf_dir):
    """Entries of the ids join one group in each document that has two or more of them that may, and no response."""
    session = _session(spark, sf_dir)
    responses = session.select("doc_id").distinct().withColumn("response", F.when(F.col("doc_id") % 4 == 0, "answer").otherwise("　"))
    return E.relate(session, _IDS, "related-99-x", responses=responses).select("doc_id", "id", "token", "group_id")


def next_group_numbers(spark, sf_dir):
    return E.next_group_number(_session(spark, sf_dir)).select("doc_id", F.col("number").cast("int").alias("number"))


def maskable_counts(spark, sf_dir):
    docs = _text("", f"concat('森さん、森林、', {_K}, '森 花子、森')")(spark, sf_dir)
    one = _session(spark, sf_dir).withColumn("doc_id", F.substring("id", 2, 9).cast("long")).withColumn("original_text", F.lit("森")).withColumn("normalized_text", F.lit("森"))
    return E.maskable(one, docs).select("doc_id", "maskable_count")


# Spans and evaluation --------------------------------------------------------------------------


def postal_strictly_in_phone(spark, sf_dir):
    docs = _text("", f"concat('電話 0123-456-', {_FOUR}, '、〒123-', {_FOUR})")(spark, sf_dir)
    inner = F.transform(S.postal_codes(F.col("text")), lambda x: x)
    return docs.select("doc_id", F.explode(inner).alias("x"), S.phones(F.col("text")).alias("p")).where(~strictly_contained(F.col("x"), F.col("p"))).select("doc_id", F.col("x.text").alias("value"))


def occurrence_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", occurrences(F.col("text"), F.lit("the")).alias("the"), occurrences(F.col("text"), F.lit("aa")).alias("aa"), occurrences(F.col("text"), F.lit("")).alias("none"))


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    category = F.when(k % 3 == 0, "PERSON").when(k % 3 == 1, "ORGANIZATION").otherwise("ADDRESS")
    expected = c.select(F.col("c_nationkey").alias("doc_id"), category.alias("category"), (k % 50).cast("int").alias("start"), (k % 50 + 3).cast("int").alias("end"), F.concat(F.lit("t"), k % 9).alias("text"))
    predicted = c.where("c_custkey % 5 <> 0").select(F.col("c_nationkey").alias("doc_id"), category.alias("category"), (k % 50 + (k % 4 == 0).cast("int")).cast("int").alias("start"), (k % 50 + 3).cast("int").alias("end"), F.concat(F.lit("t"), k % 9).alias("text"))
    return expected, predicted


_KIND = "CASE c_custkey % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' ELSE 'ADDRESS' END"
_SIDES = f"""e AS (SELECT DISTINCT c_nationkey AS doc_id, {_KIND} AS category, c_custkey % 50 AS s, c_custkey % 50 + 3 AS t, concat('t', c_custkey % 9) AS v FROM customer),
p AS (SELECT DISTINCT c_nationkey AS doc_id, {_KIND} AS category, c_custkey % 50 + CAST(c_custkey % 4 = 0 AS INT) AS s, c_custkey % 50 + 3 AS t, concat('t', c_custkey % 9) AS v FROM customer WHERE c_custkey % 5 <> 0)"""


def score_occurrence(spark, sf_dir):
    scores = scoring.score(*_sides(spark, sf_dir), "occurrence")
    return scores.select(F.coalesce("category", F.lit("all")).alias("category"), "tp", "fp", "fn", "precision", "recall", "f1")


def scoring_errors(spark, sf_dir):
    missed, wrong = scoring.errors(*_sides(spark, sf_dir), "occurrence")
    return missed.withColumn("kind", F.lit("missed")).unionByName(wrong.withColumn("kind", F.lit("wrong"))).select("kind", "doc_id", "category", "start", "end", "text")


def distinct_targets(spark, sf_dir):
    return scoring.distinct_counts(_sides(spark, sf_dir)[0])


def median_times(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("operation"), F.col("o_totalprice").cast("double").alias("ms"))
    return scoring.median_times(orders).select("operation", F.round("median_ms", 6).alias("median_ms"), "runs")


def placed_outputs(spark, sf_dir):
    """The second output has no place and is looked for behind the first, the third from there, the fourth does not occur."""
    docs = _text("", f"concat({_K}, '佐藤と佐藤と東京')")(spark, sf_dir)
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("category"), F.lit(t).alias("text")) for i, (c, t) in enumerate([("PERSON", "佐藤"), ("PERSON", "佐藤"), ("ADDRESS", "東京"), ("ADDRESS", "大阪")])])
    outputs = docs.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    return scoring.placed(docs, outputs).select("doc_id", "text", "start", "end")


def annotated_corpus(spark, sf_dir):
    docs = _text("", f"concat('x', {_K}, '[[PERSON|', {_COMPACT}, ']]と[[ADDRESS|東京]]')")(spark, sf_dir).withColumn("p", corpus.parse(F.col("text")))
    return docs.select("doc_id", F.explode("p.entities").alias("e"), F.col("p.text").alias("plain")).select("doc_id", "plain", "e.category", "e.start", "e.end", "e.text")


_CHUNK_TEXT = "concat('a', repeat('bcde ', CAST(c_custkey % 90 AS INT)), '。', repeat('fgh', CAST(c_custkey % 50 AS INT)), chr(10), repeat('ij', CAST(c_custkey % 300 AS INT)))"
_END = """CASE WHEN {s} + 320 >= length(text) THEN length(text) WHEN regexp_matches(substr(text, {s} + 192, 129), '[\\n。！？!?]')
  THEN {s} + 191 + length(regexp_extract(substr(text, {s} + 192, 129), '(?s)^.*[\\n。！？!?]')) ELSE {s} + 320 END"""
#: Windows of the rows of ``texts`` (doc_id, text), which have characters of one UTF-16 unit only.
CHUNKS = f"""WITH RECURSIVE t AS ({{texts}}),
w AS (SELECT doc_id, text, 0 AS n, 0 AS s, {_END.format(s=0)} AS e FROM t UNION ALL SELECT doc_id, text, n + 1, e - 64, {_END.format(s='(e - 64)')} FROM w WHERE e < length(text))
SELECT doc_id, CAST(n AS INT) AS n, CAST(s AS INT) AS start, CAST(e AS INT) AS "end" FROM w"""


def chunk_windows(spark, sf_dir):
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b, _ in ner.chunks(t)])

    return _text("", _CHUNK_TEXT)(spark, sf_dir).select("doc_id", F.posexplode(P.once(run)("text")).alias("n", "c")).select("doc_id", "n", "c.*")


def queries() -> dict:
    own = [
        masked_in_context, segments_in_context, availability, apply_normalized, complete_detection, set_response, clear_session, set_text, delete_entries, review_status, toggle_group, unlink_groups, relate_people,
        next_group_numbers, maskable_counts, postal_strictly_in_phone, occurrence_counts, score_occurrence, scoring_errors, distinct_targets, median_times, placed_outputs, annotated_corpus, chunk_windows,
    ]
    out = {name: _detected(name) for name in DETECTED} | {name: _normalized(t) for name, (t, _, _) in NORMALIZED.items()}
    return out | {f.__name__: f for f in own}


def oracle_sql() -> dict:
    out = {name: _detected_sql(name) for name in DETECTED}
    out |= {name: f"SELECT CAST(c_custkey AS BIGINT) AS doc_id, {_sql(value)} AS value, CAST({n} AS INT) AS changed FROM customer" for name, (_, value, n) in NORMALIZED.items()}
    return out | {
        "masked_in_context": f"SELECT CAST(c_custkey AS BIGINT) AS doc_id, concat('氏名：[人名_2]', chr(10), '[人名_1]は森林へ行く。電話[電話_1] まで') AS masked FROM customer",
        "segments_in_context": f"SELECT doc_id, s.value AS value, CAST(s.start AS INT) AS start, CAST(s.end AS INT) AS \"end\", s.token AS token FROM ({_SEGMENTS})",
        "availability": f"WITH {_DOCUMENTS} SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN 'empty' WHEN doc_id % 7 = 0 THEN 'locked' WHEN doc_id % 11 = 0 THEN 'detecting' WHEN doc_id % 13 = 0 THEN 'normalizing' ELSE 'enabled' END AS availability FROM d",
        "apply_normalized": f"WITH {_DOCUMENTS}, x AS (SELECT *, doc_id % 2 = 1 AND doc_id % 4 % 3 = revision AND lock_reason IS NULL AND doc_id % 9 <> 0 AS ok FROM d) SELECT doc_id, CASE WHEN ok THEN concat(text, 'が') ELSE text END AS text, CAST(revision + CAST(ok AS INT) AS INT) AS revision FROM x",
        "complete_detection": f"WITH {_DOCUMENTS} SELECT doc_id, coalesce(lock_reason, CASE WHEN doc_id % 10 >= 8 THEN NULL WHEN doc_id % 3 = 0 THEN 'detection_completed' WHEN doc_id % 2 = 1 THEN 'candidate_registered' END) AS lock_reason FROM d",
        "set_response": f"WITH {_DOCUMENTS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('が', doc_id) ELSE response END AS response FROM d",
        "clear_session": f"WITH {_DOCUMENTS} SELECT doc_id, '' AS text, CAST(0 AS INT) AS revision, CAST(NULL AS VARCHAR) AS lock_reason, '' AS response FROM d",
        "set_text": f"WITH {_SESSION}, {_DOCUMENTS}, x AS (SELECT s.doc_id, id, t, concat('v', d.doc_id * 3, ' v', d.doc_id * 3, text) AS text FROM s LEFT JOIN d USING (doc_id)) SELECT doc_id, id, CAST(coalesce((length(text) - length(replace(text, t, ''))) / length(t), 0) AS INT) AS occurrence_count FROM x",
        "delete_entries": f"WITH {_SESSION} SELECT doc_id, id FROM s WHERE NOT {_IN}",
        "review_status": f"WITH {_SESSION} SELECT doc_id, id, CASE WHEN {_IN} THEN 'rejected' ELSE review_status END AS review_status FROM s",
        "toggle_group": f"WITH {_SESSION}, x AS (SELECT * FROM s WHERE id = 'e6') SELECT s.doc_id, s.id, CASE WHEN s.id = 'e6' OR (s.doc_id = x.doc_id AND s.group_id = x.group_id) THEN NOT x.enabled ELSE s.enabled END AS enabled FROM s LEFT JOIN x ON true",
        "unlink_groups": f"WITH {_SESSION} SELECT doc_id, id, CASE WHEN group_id = 'related-3-x' THEN concat('[人名_', k, ']') ELSE token END AS token, nullif(group_id, 'related-3-x') AS group_id FROM s",
        "relate_people": f"""WITH {_SESSION}, own AS (SELECT doc_id, id, token, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM s
            WHERE {_IN} AND enabled AND review_status = 'approved' AND category = 'PERSON' AND group_id IS NULL AND doc_id % 4 <> 0),
            firsts AS (SELECT doc_id, token FROM own WHERE r = 1 AND n >= 2)
            SELECT s.doc_id, s.id, CASE WHEN own.n >= 2 THEN f.token ELSE s.token END AS token, CASE WHEN own.n >= 2 THEN 'related-99-x' ELSE s.group_id END AS group_id FROM s LEFT JOIN own USING (doc_id, id) LEFT JOIN firsts f USING (doc_id)""",
        "next_group_numbers": f"WITH {_SESSION} SELECT doc_id, CAST(doc_id + 2 AS INT) AS number FROM s WHERE grouped GROUP BY doc_id",
        "maskable_counts": f"WITH {_SESSION} SELECT CAST(k AS BIGINT) AS doc_id, CAST(CASE WHEN NOT enabled OR review_status <> 'approved' THEN 0 WHEN category = 'ORGANIZATION' OR k % 7 = 0 THEN 4 ELSE 3 END AS INT) AS maskable_count FROM s",
        "postal_strictly_in_phone": f"SELECT CAST(c_custkey AS BIGINT) AS doc_id, concat('〒123-', {_sql(_FOUR)}) AS value FROM customer",
        "occurrence_counts": "SELECT doc_id, CAST((length(t) - length(replace(t, 'the', ''))) / 3 AS INT) AS the, CAST((length(t) - length(replace(t, 'aa', ''))) / 2 AS INT) AS aa, CAST(0 AS INT) AS none FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
        "score_occurrence": f"""WITH {_SIDES}, x AS (SELECT coalesce(e.category, p.category) AS c, CAST(e.v IS NOT NULL AND p.v IS NOT NULL AS INT) AS tp, CAST(e.v IS NULL AS INT) AS fp, CAST(p.v IS NULL AS INT) AS fn FROM e FULL JOIN p ON e.doc_id = p.doc_id AND e.category = p.category AND e.s = p.s AND e.t = p.t AND e.v = p.v),
            n AS (SELECT coalesce(c, 'all') AS category, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM x GROUP BY ROLLUP (c)),
            r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall FROM n)
            SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM r""",
        "scoring_errors": f"WITH {_SIDES} SELECT 'missed' AS kind, doc_id, category, CAST(s AS INT) AS start, CAST(t AS INT) AS \"end\", v AS text FROM (SELECT * FROM e EXCEPT SELECT * FROM p) UNION ALL SELECT 'wrong', doc_id, category, CAST(s AS INT), CAST(t AS INT), v FROM (SELECT * FROM p EXCEPT SELECT * FROM e)",
        "distinct_targets": f"WITH {_SIDES} SELECT category, count(DISTINCT (doc_id, v)) AS targets, count(DISTINCT (doc_id, s, t)) AS occurrences FROM e GROUP BY 1",
        "median_times": "SELECT o_orderpriority AS operation, round(median(CAST(o_totalprice AS DOUBLE)), 6) AS median_ms, count(*) AS runs FROM orders GROUP BY 1",
        "placed_outputs": f"SELECT CAST(c_custkey AS BIGINT) AS doc_id, v.text AS text, CAST(length({_sql(_K)}) + v.place AS INT) AS start, CAST(length({_sql(_K)}) + v.place + 2 AS INT) AS \"end\" FROM customer, (VALUES ('佐藤', 0), ('佐藤', 3), ('東京', 6)) v(text, place)",
        "annotated_corpus": f"""SELECT CAST(c_custkey AS BIGINT) AS doc_id, concat('x', {_sql(_K)}, {_sql(_COMPACT)}, 'と東京') AS plain, v.category AS category, CAST(1 + length({_sql(_K)}) + v.place AS INT) AS start, CAST(1 + length({_sql(_K)}) + v.place + v.n AS INT) AS "end",
            CASE WHEN v.category = 'PERSON' THEN {_sql(_COMPACT)} ELSE '東京' END AS text FROM customer, (VALUES ('PERSON', 0, 4), ('ADDRESS', 5, 2)) v(category, place, n)""",
        "chunk_windows": CHUNKS.format(texts=f"SELECT CAST(c_custkey AS BIGINT) AS doc_id, {_CHUNK_TEXT} AS text FROM customer"),
    }
