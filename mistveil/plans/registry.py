"""Named queries of the masking engine and their DuckDB equivalents.

RE2 has no look-ahead. The oracles double every boundary character that no value contains, and then consume a
boundary on both sides. Japanese texts are generated from columns of ``customer`` and ``orders``, on both sides alike.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import fold_fullwidth_col
from ..operators import docnorm, entries as E, masking as M, ner, pipeline as P, scoring, structured as S
from ..operators.names import addresses, birth_dates, credentials, titled_names
from ..operators.spans import occurrences, outside
from ..sources.texts import nfc
from . import cases


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "text")


def _each(df: DataFrame, spans) -> DataFrame:
    return df.select("doc_id", F.explode(spans).alias("x")).groupBy("doc_id", F.col("x.text").alias("value")).agg(F.count("*").alias("n"))


# Generated texts: (doc_id, text) in Spark, the same expression in SQL ----------------------

_GEN = {
    "contact": ("customer", "c_custkey", "concat('郵便番号は', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-', lpad(CAST(c_nationkey AS STRING), 4, '0'), '、電話は090-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), '-', lpad(CAST(c_nationkey AS STRING), 4, '0'), '、参照先は（https://host', CAST(c_custkey AS STRING), '.example.test/a?b=', CAST(c_nationkey AS STRING), '）、接続元は10.0.', CAST(c_nationkey AS STRING), '.', CAST(c_custkey % 300 AS STRING), '、宛先は user', CAST(c_custkey AS STRING), '@example.test です')"),
    "spaced_phone": ("customer", "c_custkey", "concat('電話045 ', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-', lpad(CAST(c_nationkey AS STRING), 4, '0'), 'です。番号', lpad(CAST(c_nationkey AS STRING), 3, '0'), '-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))"),
    "url_ip": ("customer", "c_custkey", "concat('https://10.0.', CAST(c_nationkey AS STRING), '.', CAST(c_custkey % 256 AS STRING), '/a と 10.1.', CAST(c_nationkey AS STRING), '.', CAST(c_custkey % 256 AS STRING))"),
    "birth": ("orders", "o_orderkey", "concat('生年月日「', CAST(year(o_orderdate) AS STRING), '年', CAST(month(o_orderdate) AS STRING), '月', CAST(o_orderkey % 33 AS STRING), '日」')"),
    "address": ("customer", "c_custkey", "concat('住所：東京都千代田区丸の内', CAST(1 + c_nationkey AS STRING), '-', CAST(1 + c_custkey % 20 AS STRING), '-', CAST(1 + c_custkey % 7 AS STRING), 'です')"),
    "titled": ("customer", "c_custkey", "concat('本日は', CASE c_custkey % 4 WHEN 0 THEN '佐藤' WHEN 1 THEN '高橋' WHEN 2 THEN '渡辺' ELSE '仕' END, '様が来ます')"),
    "secret": ("customer", "c_custkey", "concat('パスワード「pw-', CAST(c_custkey AS STRING), '」とID: u', CAST(c_nationkey AS STRING), 'xx')"),
    "width": ("customer", "c_custkey", "concat('電話　０９０－', translate(lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), '0123456789', '０１２３４５６７８９'), '  ＡＢＣ', chr(13), chr(10), chr(10), chr(10), chr(10), 'ｚ', chr(9), chr(9), '！')"),
    "marks": ("customer", "c_custkey", f"concat('cafe{chr(0x301)} ', CAST(c_custkey AS STRING), ' か{chr(0x3099)}u{chr(0x308)}')"),
}


def _generated(name: str):
    table, key, text = _GEN[name]
    return lambda spark, sf_dir: _t(spark, sf_dir, table).select(F.col(key).alias("doc_id"), F.expr(text).alias("text"), "*")


def _gen_sql(name: str, extra: str = "*") -> str:
    table, key, text = _GEN[name]
    return f"(SELECT {key} AS doc_id, {text.replace('AS STRING', 'AS VARCHAR')} AS text, {extra} FROM {table})"


def _found(detector):
    """(doc_id, value) of a detector that works on text in the row."""

    def of(df: DataFrame) -> DataFrame:
        return P.exploded(P.with_candidates(df.select("doc_id", "text"), detector)).select("doc_id", F.col("text").alias("value"))

    return of


# Detection over documents ----------------------------------------------------------------


def detect_emails(spark, sf_dir):
    return _each(_docs(spark, sf_dir), S.emails(F.col("text")))


def detect_ipv4(spark, sf_dir):
    return _each(_docs(spark, sf_dir), F.filter(S.ip_addresses(F.col("text")), lambda x: x["text"].contains(".")))


def detect_postal_codes(spark, sf_dir):
    return _each(_docs(spark, sf_dir), S.postal_codes(F.col("text")))


def detect_urls(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("see "), "url", F.lit(" .")).alias("text"))
    return _each(pages, S.urls(F.col("text")))


def candidate_union_distinct(spark, sf_dir):
    df = _generated("contact")(spark, sf_dir)
    return df.select("doc_id", F.explode(S.structured(F.col("text"))).alias("c")).select("doc_id", "c.category", F.col("c.text").alias("value"))


def postal_not_in_phone(spark, sf_dir):
    df = _generated("spaced_phone")(spark, sf_dir)
    text = F.col("text")
    return df.select("doc_id", F.explode(outside(S.postal_codes(text), S.phones(text))).alias("x")).select("doc_id", F.col("x.text").alias("value"))


def ip_not_in_url(spark, sf_dir):
    df = _generated("url_ip")(spark, sf_dir)
    text = F.col("text")
    return df.select("doc_id", F.explode(outside(S.ip_addresses(text), S.urls(text))).alias("x")).select("doc_id", F.col("x.text").alias("value"))


# Entries of documents ----------------------------------------------------------------------


def _with_entries(spark, sf_dir) -> DataFrame:
    """Documents and their entries by the structured detectors, all in the document's row."""
    docs = _docs(spark, sf_dir)
    return docs.withColumn("entries", E.in_row(F.col("text"), S.structured(F.col("text"))))


def _entries(spark, sf_dir) -> DataFrame:
    return _with_entries(spark, sf_dir).select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.*")


def token_assignment(spark, sf_dir):
    return _entries(spark, sf_dir).select("doc_id", "category", F.col("text").alias("value"), "token", "occurrence_count")


def _with_pairs(spark, sf_dir) -> DataFrame:
    pairs = F.transform("entries", lambda e: F.struct(e["text"].alias("text"), e["token"].alias("token")))
    return _with_entries(spark, sf_dir).withColumn("pairs", pairs).withColumn("masked", M.mask(F.col("text"), F.col("pairs")))


def masked_documents(spark, sf_dir):
    return _with_pairs(spark, sf_dir).select("doc_id", F.size("pairs").alias("n_entries"), "masked")


def restore_roundtrip(spark, sf_dir):
    return _with_pairs(spark, sf_dir).select("doc_id", M.restore(F.col("masked"), F.col("pairs")).alias("restored"))


def token_inspection(spark, sf_dir):
    """The response of each document is its masked text without the first e-mail token, and with one unknown token."""
    response = F.concat(F.replace("masked", F.lit("[メール_1]"), F.lit("")), F.lit(" [人名_99]"))
    x = M.inspect(response, F.transform("pairs", lambda p: p["token"]), F.transform("pairs", lambda p: p["text"]), F.col("masked"))
    df = _with_pairs(spark, sf_dir).select("doc_id", x.alias("x"))
    return df.select("doc_id", *[F.size(f"x.{c}").alias(c) for c in ("known_present", "absent", "unknown", "natural")])


def _status(df: DataFrame) -> DataFrame:
    """Entries with states that depend on their key, so that all of them occur."""
    h = F.pmod(F.col("doc_id") + F.length("text"), F.lit(5))
    return df.withColumns({"enabled": h != 0, "review_status": F.when(h == 1, "unreviewed").otherwise("approved"), "sources": F.when(h == 2, F.array(F.lit("manual"))).otherwise(F.array(F.lit("regex"))), "promoted_at": F.when(h == 2, F.col("doc_id")).cast("long"), "original_text": F.col("text"), "display_order": F.col("ord")})


def session_counts(spark, sf_dir):
    return E.counts(_status(_entries(spark, sf_dir)))


def visible_entries(spark, sf_dir):
    df = E.visible(_status(_entries(spark, sf_dir)), "enabled", "_1")
    return df.select("doc_id", F.col("text").alias("value"), "token", "review_rank")


def replacement_counts(spark, sf_dir):
    return E.active(_status(_entries(spark, sf_dir))).groupBy("category").agg(F.sum("occurrence_count").alias("replacements"), F.count("*").alias("entries"))


def merge_summary(spark, sf_dir):
    """What the structured detectors find, against entries for all but IP addresses."""
    found = _entries(spark, sf_dir)
    known = found.where("category <> 'OTHER'").select("doc_id", F.col("text").alias("normalized_text"))
    return E.merge_summary(found, known)


# Scoring -----------------------------------------------------------------------------------


def score_target(spark, sf_dir):
    """IP addresses and e-mails as expected, against longer addresses, e-mails, and short addresses taken for e-mails; one scan."""
    text = F.col("text")
    ip, mail = F.filter(S.ip_addresses(text), lambda x: x["text"].contains(".")), S.emails(text)
    side = lambda a, c, e: F.transform(a, lambda x: F.struct(F.lit(c).alias("category"), x["text"].alias("text"), F.lit(e).alias("e"), F.lit(1 - e).alias("p")))
    long_, short = F.filter(ip, lambda x: F.length(x["text"]) > 12), F.filter(ip, lambda x: F.length(x["text"]) < 11)
    every = F.concat(side(ip, "OTHER", 1), side(mail, "EMAIL", 1), side(long_, "OTHER", 0), side(mail, "EMAIL", 0), side(short, "EMAIL", 0))
    sides = _docs(spark, sf_dir).select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.*")
    return scoring.summarise(sides, ["doc_id", "category", "text"]).select(F.coalesce("category", F.lit("all")).alias("category"), "tp", "fp", "fn", "precision", "recall", "f1")


# Text functions ------------------------------------------------------------------------------


def nfc_text(spark, sf_dir):
    return _generated("marks")(spark, sf_dir).select("doc_id", nfc(F.col("text")).alias("value"))


def fullwidth_fold(spark, sf_dir):
    return _generated("width")(spark, sf_dir).select("doc_id", fold_fullwidth_col(F.col("text")).alias("value"))


def excess_whitespace(spark, sf_dir):
    text = F.regexp_replace(F.regexp_replace("text", "\\r\\n?", "\n"), "[ \\t]{2,}", " ")
    return _generated("width")(spark, sf_dir).select("doc_id", F.regexp_replace(text, "\\n{3,}", "\n\n").alias("value"))


def range_coalesce(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 1000).cast("int").alias("start"), (F.col("event_id") % 1000 + F.col("event_id") % 17).cast("int").alias("end"))
    return E.coalesce_ranges(ev)


def rule_summary(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    return ev.groupBy(F.col("event_type").alias("rule_id"), (F.col("event_id") % 3).alias("kind")).agg(F.count("*").alias("n"))


def group_labels(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("related-"), F.col("c_custkey") % 7 + 1, F.lit("-x"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("free-"), F.col("c_custkey") % 5)).alias("group_id"), F.col("c_custkey").cast("int").alias("display_order"))
    return E.group_numbers(c)


# Row-local operators without an SQL equivalent -------------------------------------------------


def all_candidates(spark, sf_dir):
    return P.exploded(P.with_candidates(_docs(spark, sf_dir))).drop("rules")


def document_entries(spark, sf_dir):
    return E.from_docs(P.with_entries(_docs(spark, sf_dir)).drop("text")).select("doc_id", "token", "normalized_text", "category", "occurrence_count", "display_order")


def contextual_mask(spark, sf_dir):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: M.mask_text(t or "", P.merge(t or "", [], P.all_candidates(t or ""))))

    return _docs(spark, sf_dir).select("doc_id", run("text").alias("masked"))


def highlight_segments(spark, sf_dir):
    @F.pandas_udf("array<struct<type:string,value:string,start:int,end:int,token:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{k: s[k] for k in ("type", "value", "start", "end", "token")} for s in M.segments(t or "", P.merge(t or "", [], P.all_candidates(t or "")), everything=True)])

    return _docs(spark, sf_dir).select("doc_id", F.explode(P.once(run)("text")).alias("s")).select("doc_id", "s.*")


def document_normalization(spark, sf_dir):
    @F.pandas_udf("struct<normalized_text:string,changed:int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [docnorm.normalize_document(t or "", "detection_priority", mappings=False) for t in texts]
        return pd.DataFrame({"normalized_text": [r["normalized_text"] for r in found], "changed": [r["changed_location_count"] for r in found]})

    return _docs(spark, sf_dir).select("doc_id", run("text").alias("r")).select("doc_id", "r.*")


def chunk_text(spark, sf_dir):
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b, _ in ner.chunks(t or "")])

    return _docs(spark, sf_dir).select("doc_id", F.posexplode(P.once(run)("text")).alias("n", "c")).select("doc_id", "n", "c.*")


def _by(name: str, detector):
    return lambda spark, sf_dir: _found(detector)(_generated(name)(spark, sf_dir))


def queries() -> dict:
    own = [
        detect_emails, detect_ipv4, detect_postal_codes, detect_urls, candidate_union_distinct, postal_not_in_phone, ip_not_in_url, token_assignment, masked_documents, restore_roundtrip, token_inspection, session_counts,
        visible_entries, replacement_counts, merge_summary, score_target, nfc_text, fullwidth_fold, excess_whitespace, range_coalesce, rule_summary, group_labels, all_candidates, document_entries, contextual_mask, highlight_segments,
        document_normalization, chunk_text,
    ]
    out = {f.__name__: f for f in own}
    out |= cases.queries()
    out |= {"detect_birth_dates": _by("birth", birth_dates), "detect_addresses": _by("address", addresses), "detect_honorific_names": _by("titled", titled_names), "detect_secrets_derived": _by("secret", credentials), "detect_phones": _by("contact", P.phones)}
    return out


# Oracles -------------------------------------------------------------------------------------

_SIDE = "0-9０-９A-Za-zＡ-Ｚａ-ｚ‐‑‒–—―－ーｰ-"
_LOCAL = "A-Za-z0-9.!#$%&''*+/=?^_`{|}~-"


def _all(pattern: str, double: str, where: str, table: str = "documents", value: str = "v") -> str:
    return f"SELECT doc_id, i, {value} AS v FROM (SELECT doc_id, unnest(vs) AS v, generate_subscripts(vs, 1) AS i FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([^{double}])', '\\1\\1', 'g'), '{pattern}', 2) AS vs FROM {table})) WHERE {where}"


_EMAILS = _all(f"(^|[^A-Za-z0-9._%+-])([{_LOCAL}]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+)($|[^A-Za-z0-9._%+-])", _LOCAL[:-1] + "@-", "regexp_full_match(v, '[^@]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\\.)+[A-Za-z]{2,}') AND v NOT LIKE '.%' AND v NOT LIKE '%.@%' AND v NOT LIKE '%..%'", value="trim(v, '\"''.,;:!?([])')")
_IPS = _all("(?m)(^|[^0-9.])([0-9]{1,3}(?:\\.[0-9]{1,3}){3})($|[^0-9.])", "0-9.", "list_bool_and(list_transform(string_split(v, '.'), lambda p: regexp_full_match(p, '0|[1-9][0-9]{0,2}') AND CAST(p AS INT) <= 255))")
_POSTALS = _all(f"(^|[^{_SIDE}])([0-9]{{3}}[‐‑‒–—―－ーｰ-][0-9]{{4}})($|[^{_SIDE}])", _SIDE, "true")
_EACH = "SELECT doc_id, v AS value, count(*) AS n FROM ({}) GROUP BY 1, 2"
_FIRST = f"""
hits AS (SELECT doc_id, 'EMAIL' AS category, 1 AS k, i, v FROM ({_EMAILS}) UNION ALL SELECT doc_id, 'POSTAL_CODE', 2, i, v FROM ({_POSTALS}) UNION ALL SELECT doc_id, 'OTHER', 3, i, v FROM ({_IPS})),
firsts AS (SELECT doc_id, v, arg_min(category, k * 1000000 + i) AS category, min(k * 1000000 + i) AS o FROM hits GROUP BY 1, 2),
entries AS (SELECT f.doc_id, f.v, f.category, f.o, d.text AS source_text,
    concat('[', CASE f.category WHEN 'EMAIL' THEN 'メール' WHEN 'POSTAL_CODE' THEN '郵便番号' ELSE 'その他' END, '_', row_number() OVER (PARTITION BY f.doc_id, f.category ORDER BY f.o), ']') AS token,
    CAST((length(d.text) - length(replace(d.text, f.v, ''))) / length(f.v) AS INT) AS occurrence_count FROM firsts f JOIN documents d USING (doc_id)),
lists AS (SELECT doc_id, list(struct_pack(t := v, k := token) ORDER BY length(v) DESC, v) AS es FROM entries GROUP BY 1),
masked AS (SELECT d.doc_id, coalesce(len(es), 0) AS n_entries, d.text, es, list_reduce(list_prepend(struct_pack(t := d.text, k := ''), coalesce(es, [])), lambda a, e: struct_pack(t := replace(a.t, e.t, e.k), k := '')).t AS masked FROM documents d LEFT JOIN lists l USING (doc_id)),
states AS (SELECT *, (doc_id + length(v)) % 5 AS h FROM entries)
"""


def oracle_sql() -> dict:
    custom = {k: _gen_sql(k) for k in _GEN}
    return cases.oracle_sql() | {
        "detect_emails": _EACH.format(_EMAILS),
        "detect_ipv4": _EACH.format(_IPS),
        "detect_postal_codes": _EACH.format(_POSTALS),
        "detect_urls": "SELECT page_id AS doc_id, url AS value, count(*) AS n FROM pages GROUP BY 1, 2",
        "candidate_union_distinct": f"""SELECT doc_id, 'POSTAL_CODE' AS category, concat(lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0'), '-', lpad(CAST(c_nationkey AS VARCHAR), 4, '0')) AS value FROM {custom['contact']}
            UNION ALL SELECT doc_id, 'PHONE', concat('090-', lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0'), '-', lpad(CAST(c_nationkey AS VARCHAR), 4, '0')) FROM {custom['contact']}
            UNION ALL SELECT doc_id, 'OTHER', concat('https://host', doc_id, '.example.test/a?b=', c_nationkey) FROM {custom['contact']}
            UNION ALL SELECT doc_id, 'OTHER', concat('10.0.', c_nationkey, '.', doc_id % 300) FROM {custom['contact']} WHERE doc_id % 300 <= 255
            UNION ALL SELECT doc_id, 'EMAIL', concat('user', doc_id, '@example.test') FROM {custom['contact']}""",
        "detect_phones": f"SELECT doc_id, concat('090-', lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0'), '-', lpad(CAST(c_nationkey AS VARCHAR), 4, '0')) AS value FROM {custom['contact']}",
        "postal_not_in_phone": f"SELECT doc_id, concat(lpad(CAST(c_nationkey AS VARCHAR), 3, '0'), '-', lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0')) AS value FROM {custom['spaced_phone']}",
        "ip_not_in_url": f"SELECT doc_id, concat('10.1.', c_nationkey, '.', doc_id % 256) AS value FROM {custom['url_ip']}",
        "detect_birth_dates": f"SELECT doc_id, concat(year(o_orderdate), '年', month(o_orderdate), '月', doc_id % 33, '日') AS value FROM {custom['birth']} WHERE doc_id % 33 BETWEEN 1 AND day(last_day(o_orderdate))",
        "detect_addresses": f"SELECT doc_id, concat('東京都千代田区丸の内', 1 + c_nationkey, '-', 1 + doc_id % 20, '-', 1 + doc_id % 7) AS value FROM {custom['address']}",
        "detect_honorific_names": f"SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN '佐藤' WHEN 1 THEN '高橋' ELSE '渡辺' END, '様') AS value FROM {custom['titled']} WHERE doc_id % 4 <> 3",
        "detect_secrets_derived": f"SELECT doc_id, concat('pw-', doc_id) AS value FROM {custom['secret']} UNION ALL SELECT doc_id, concat('u', c_nationkey, 'xx') FROM {custom['secret']}",
        "token_assignment": f"WITH {_FIRST} SELECT doc_id, category, v AS value, token, occurrence_count FROM entries",
        "masked_documents": f"WITH {_FIRST} SELECT doc_id, CAST(n_entries AS INT) AS n_entries, masked FROM masked",
        "restore_roundtrip": "SELECT doc_id, text AS restored FROM documents",
        "token_inspection": f"WITH {_FIRST} SELECT doc_id, CAST(n_entries - m AS INT) AS known_present, m AS absent, CAST(1 AS INT) AS unknown, CAST(0 AS INT) AS natural FROM (SELECT doc_id, n_entries, CAST(contains(masked, '[メール_1]') AS INT) AS m FROM masked)",
        "session_counts": f"WITH {_FIRST} SELECT doc_id, count(*) FILTER (WHERE h NOT IN (0, 1)) AS active, CAST(coalesce(sum(occurrence_count) FILTER (WHERE h NOT IN (0, 1)), 0) AS BIGINT) AS replacements, count(*) AS total, count(*) FILTER (WHERE h = 0) AS disabled, count(*) FILTER (WHERE occurrence_count = 0) AS zero_occurrence FROM states GROUP BY 1",
        "replacement_counts": f"WITH {_FIRST} SELECT category, CAST(sum(occurrence_count) AS BIGINT) AS replacements, count(*) AS entries FROM states WHERE h NOT IN (0, 1) GROUP BY 1",
        "merge_summary": f"WITH {_FIRST} SELECT doc_id, count(*) FILTER (WHERE category = 'OTHER') AS added, count(*) FILTER (WHERE category <> 'OTHER') AS merged FROM firsts GROUP BY 1",
        "visible_entries": f"WITH {_FIRST} SELECT doc_id, v AS value, token, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY (h = 2) DESC, CASE WHEN h = 2 THEN o END NULLS LAST, instr(source_text, v), length(v) DESC, o) AS INT) AS review_rank FROM states WHERE h <> 0 AND (contains(lower(v), '_1') OR contains(lower(token), '_1'))",
        "score_target": f"""WITH ip AS (SELECT DISTINCT doc_id, v FROM ({_IPS})), mail AS (SELECT DISTINCT doc_id, v FROM ({_EMAILS})),
            e AS (SELECT doc_id, 'OTHER' AS c, v FROM ip UNION SELECT doc_id, 'EMAIL', v FROM mail),
            p AS (SELECT doc_id, 'OTHER' AS c, v FROM ip WHERE length(v) > 12 UNION SELECT doc_id, 'EMAIL', v FROM mail UNION SELECT doc_id, 'EMAIL', v FROM ip WHERE length(v) < 11),
            x AS (SELECT coalesce(e.c, p.c) AS c, CAST(e.v IS NOT NULL AND p.v IS NOT NULL AS INT) AS tp, CAST(e.v IS NULL AS INT) AS fp, CAST(p.v IS NULL AS INT) AS fn FROM e FULL JOIN p ON e.doc_id = p.doc_id AND e.c = p.c AND e.v = p.v),
            s AS (SELECT coalesce(c, 'all') AS category, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM x GROUP BY ROLLUP (c)),
            r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall FROM s)
            SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM r""",
        "chunk_text": cases.CHUNKS.format(texts="SELECT doc_id, text FROM documents WHERE length(text) > 0"),
        "nfc_text": f"SELECT doc_id, nfc_normalize(text) AS value FROM {custom['marks']}",
        "fullwidth_fold": f"SELECT doc_id, translate(text, '０１２３４５６７８９ＡＢＣｚ！－', '0123456789ABCz!-') AS value FROM {custom['width']}",
        "excess_whitespace": f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', concat(chr(10), chr(10)), 'g') AS value FROM {custom['width']}",
        "range_coalesce": """WITH r AS (SELECT user_id AS doc_id, CAST(event_id % 1000 AS INT) AS s, CAST(event_id % 1000 + event_id % 17 AS INT) AS e FROM events),
            m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r),
            g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
            SELECT doc_id, min(s) AS start, max(e) AS "end" FROM g GROUP BY doc_id, k""",
        "rule_summary": "SELECT event_type AS rule_id, event_id % 3 AS kind, count(*) AS n FROM events GROUP BY 1, 2",
        "group_labels": """WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN concat('related-', c_custkey % 7 + 1, '-x') WHEN c_custkey % 3 = 1 THEN concat('free-', c_custkey % 5) END AS group_id, c_custkey AS o FROM customer),
            g AS (SELECT doc_id, group_id, min(o) AS f, TRY_CAST(nullif(regexp_extract(group_id, '^related-([0-9]+)-', 1), '') AS INT) AS given FROM c WHERE group_id IS NOT NULL GROUP BY 1, 2)
            SELECT doc_id, group_id, CAST(coalesce(given, coalesce(max(given) OVER (PARTITION BY doc_id), 0) + row_number() OVER (PARTITION BY doc_id, given IS NULL ORDER BY f, group_id)) AS INT) AS number FROM g""",
    }
