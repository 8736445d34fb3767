"""Session operations and views over the table of entries, as DataFrame functions.

``entries`` has one row a document and distinct string: the columns of ``schema``. Every function returns a new
table; what looks at a group or a document is a window over it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chars import blank
from ..functions.lexicon import AMBIGUOUS, CATEGORY_LABELS
from ..sources.texts import nfc
from .spans import occurrences

schema = (
    "doc_id long, id string, original_text string, normalized_text string, restoration_text string, token string, category string, group_id string, "
    "group_backup_restoration string, group_backup_token string, sources array<string>, confidence double, rules array<string>, enabled boolean, "
    "occurrence_count int, review_status string, display_order int, promoted_at long"
)


def from_docs(docs: DataFrame) -> DataFrame:
    """The entries table of documents with an ``entries`` array."""
    e = docs.select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.*")
    none = F.lit(None)
    return e.select(
        "doc_id", F.concat_ws("-", "doc_id", "display_order").alias("id"), "original_text", "normalized_text", "restoration_text", "token", "category",
        none.cast("string").alias("group_id"), none.cast("string").alias("group_backup_restoration"), none.cast("string").alias("group_backup_token"),
        "sources", "confidence", "rules", "enabled", "occurrence_count", "review_status", "display_order", none.cast("long").alias("promoted_at"),
    )


def is_active() -> Column:
    return F.col("enabled") & (F.col("review_status") == "approved")


def active(entries: DataFrame) -> DataFrame:
    return entries.where(is_active())


def number_tokens(found: DataFrame) -> DataFrame:
    """Tokens for (doc_id, category, ord, text, source_text): per document and category in order, without numbers that the text itself has.

    The n-th entry gets the n-th number whose token the text does not contain.
    """
    label = F.element_at(F.create_map(*[F.lit(x) for p in CATEGORY_LABELS.items() for x in p]), F.col("category"))
    own = Window.partitionBy("doc_id", "category")
    taken = F.transform(F.regexp_extract_all("source_text", F.concat(F.lit("\\[\\Q"), label, F.lit("\\E_([1-9][0-9]{0,5})\\]")), F.lit(1)), lambda x: x.cast("int"))
    ranked = found.withColumn("n", F.row_number().over(own.orderBy("ord"))).withColumn("taken", F.array_distinct(taken))
    free = F.array_except(F.sequence(F.lit(1), F.col("n") + F.size("taken")), F.col("taken"))
    return ranked.withColumn("token", F.concat(F.lit("["), label, F.lit("_"), F.element_at(free, F.col("n")).cast("string"), F.lit("]"))).drop("n", "taken")


def in_row(text: Column, found: Column) -> Column:
    """Entries of a document in its row, from its candidates (category, text, ...) in order: no shuffle.

    array<struct<ord, category, text, token, occurrence_count, position>>: distinct strings, of which the first category stays, with
    tokens numbered by category; numbers whose token the text has are skipped. Positions are from 1, by first occurrence.
    """
    empty = F.array().cast("array<struct<ord:int,category:string,text:string,token:string,occurrence_count:int,position:int>>")
    label_of = F.create_map(*[F.lit(x) for p in CATEGORY_LABELS.items() for x in p])

    def step(acc: Column, x: Column) -> Column:
        label = F.element_at(label_of, x["category"])
        n = F.size(F.filter(acc, lambda a: a["category"] == x["category"])) + 1
        own = F.transform(F.regexp_extract_all(text, F.concat(F.lit("\\[\\Q"), label, F.lit("\\E_([1-9][0-9]{0,5})\\]")), F.lit(1)), lambda m: m.cast("int"))
        taken = F.when(text.contains(F.concat(F.lit("["), label, F.lit("_"))), F.array_distinct(own)).otherwise(F.array().cast("array<int>"))
        number = F.element_at(F.array_except(F.sequence(F.lit(1), n + F.size(taken)), taken), n)
        token = F.concat(F.lit("["), label, F.lit("_"), number.cast("string"), F.lit("]"))
        new = F.struct(x["ord"].alias("ord"), x["category"].alias("category"), x["text"].alias("text"), token.alias("token"), occurrences(text, x["text"]).alias("occurrence_count"), F.instr(text, x["text"]).alias("position"))
        return F.when(F.exists(acc, lambda a: a["text"] == x["text"]), acc).otherwise(F.array_append(acc, new))

    placed = F.transform(found, lambda x, i: F.struct(i.alias("ord"), x["category"].alias("category"), x["text"].alias("text")))
    return F.aggregate(placed, empty, step)


# Views ----------------------------------------------------------------------------------


def visible(entries: DataFrame, view: str = "all", query: str = "") -> DataFrame:
    """Filtered and searched entries with their rank in the review order.

    Promoted ones first, the latest promotion first; then by first place in the text (``position``, nulls last), longer first, and display order.
    """
    out = entries
    if view in ("enabled", "disabled"):
        out = out.where(F.col("enabled") == (view == "enabled"))
    q = query.strip().lower()
    if q:
        out = out.where(F.lower("original_text").contains(q) | F.lower("token").contains(q))
    manual = F.array_contains("sources", "manual")
    order = [manual.desc(), F.col("promoted_at").desc_nulls_last(), F.when(manual, F.col("display_order")).asc_nulls_last(), F.col("position").asc_nulls_last(), F.length("original_text").desc(), F.col("display_order").asc()]
    return out.withColumn("review_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def counts(entries: DataFrame) -> DataFrame:
    on = F.when(is_active(), F.col("occurrence_count")).otherwise(0)
    return entries.groupBy("doc_id").agg(
        F.count_if(is_active()).alias("active"), F.sum(on).alias("replacements"), F.count("*").alias("total"), F.count_if(~F.col("enabled")).alias("disabled"), F.count_if(F.col("occurrence_count") == 0).alias("zero_occurrence")
    )


def snapshot_order(entries: DataFrame) -> DataFrame:
    """Active entries with their rank in a saved mapping: by target and token in Japanese collation, then by id."""
    order = [F.collate("normalized_text", "ja"), F.collate("token", "ja"), F.col("id")]
    return active(entries).withColumn("snapshot_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


# Transitions ----------------------------------------------------------------------------


def set_text(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """Occurrences counted again on the documents' new texts; entries that no longer occur stay."""
    text = docs.select("doc_id", F.col("text").alias("__text"))
    return entries.join(text, "doc_id", "left").withColumn("occurrence_count", F.coalesce(occurrences(F.col("__text"), F.col("normalized_text")), F.lit(0))).drop("__text")


def revised(docs: DataFrame, new: Column) -> DataFrame:
    """``docs`` with text replaced and revision raised where it differs."""
    return docs.withColumn("revision", F.when(F.col("text").eqNullSafe(new), F.col("revision")).otherwise(F.col("revision") + 1)).withColumn("text", new)


def availability(docs: DataFrame) -> DataFrame:
    """Whether a document may be normalized; the reasons in the order in which they count."""
    reason = F.when(blank(F.coalesce("text", F.lit(""))), "empty").when(F.col("locked"), "locked").when(F.col("detecting"), "detecting").when(F.col("normalizing"), "normalizing").otherwise("enabled")
    return docs.withColumn("availability", reason)


def add_manual(entries: DataFrame, items: DataFrame) -> DataFrame:
    """``items`` (doc_id, text, category, token, occurrence_count): an existing string takes the category, is enabled and promoted; a new one goes first."""
    doc = Window.partitionBy("doc_id")
    new = items.where(~blank(F.col("text"))).select("doc_id", F.col("text").alias("__text"), F.col("category").alias("__category"), F.col("token").alias("__token"), F.col("occurrence_count").alias("__n"))
    joined = entries.join(new, (entries["doc_id"] == new["doc_id"]) & (entries["normalized_text"] == new["__text"]), "full_outer").select(*[entries[c] for c in entries.columns], new["doc_id"].alias("__doc"), "__text", "__category", "__token", "__n")
    hit, fresh = F.col("__text").isNotNull(), F.col("doc_id").isNull()
    joined = joined.withColumn("doc_id", F.coalesce("doc_id", "__doc"))
    promoted = F.coalesce(F.max("promoted_at").over(doc), F.lit(0)) + 1
    at = F.when(hit, promoted).otherwise(F.col("promoted_at"))
    out = joined.withColumn("promoted_at", at).withColumns(
        {
            "category": F.coalesce("__category", "category"), "enabled": hit | F.coalesce("enabled", F.lit(False)), "review_status": F.when(hit, "approved").otherwise(F.col("review_status")),
            "sources": F.when(hit, F.array_union(F.coalesce("sources", F.array().cast("array<string>")), F.array(F.lit("manual")))).otherwise(F.col("sources")),
            "id": F.coalesce("id", F.concat_ws("-", "doc_id", F.lit("manual"), "__text")), "token": F.coalesce("token", "__token"), "occurrence_count": F.coalesce("occurrence_count", "__n"),
            "display_order": F.when(fresh, -1).otherwise(F.col("display_order")),
        } | {c: F.coalesce(c, "__text") for c in ("original_text", "normalized_text", "restoration_text")}
    )
    order = F.row_number().over(doc.orderBy("display_order", "normalized_text")) - 1
    return out.withColumn("display_order", order).select(*entries.columns)


def set_status(entries: DataFrame, ids: list[str], status: str) -> DataFrame:
    return entries.withColumn("review_status", F.when(F.col("id").isin(ids), status).otherwise(F.col("review_status")))


def delete(entries: DataFrame, ids: list[str]) -> DataFrame:
    return entries.where(~F.col("id").isin(ids))


def toggle(entries: DataFrame, entry_id: str) -> DataFrame:
    """The entry, and all of its group, to the opposite of what the entry is."""
    group = Window.partitionBy("doc_id", F.coalesce("group_id", "id"))
    target = F.max(F.when(F.col("id") == entry_id, ~F.col("enabled"))).over(group)
    return entries.withColumn("enabled", F.coalesce(target, F.col("enabled")))


def relate(entries: DataFrame, ids: list[str], group_id: str, restoration: str | None = None, responses: DataFrame | None = None) -> DataFrame:
    """The active, ungrouped people among ``ids`` share the first one's token and its (or the given) restoration, once two or more are in the group.

    ``responses`` (doc_id, response): while a document has one that is not blank, its entries stay as they are.
    """
    if responses is not None:
        busy = responses.where(F.col("response").isNotNull() & ~blank(F.col("response"))).select("doc_id").distinct()
        free = relate(entries.join(busy, "doc_id", "left_anti").select(*entries.columns), ids, group_id, restoration)
        return free.unionByName(entries.join(busy, "doc_id", "left_semi").select(*entries.columns))
    own = F.col("id").isin(ids) & is_active() & (F.col("category") == "PERSON") & (F.col("group_id").isNull() | (F.col("group_id") == group_id))
    doc = Window.partitionBy("doc_id")
    first = F.array_position(F.array(*map(F.lit, ids)), F.col("id"))
    lead = lambda c: F.min_by(F.when(own | (F.col("group_id") == group_id), F.col(c)), F.when(own | (F.col("group_id") == group_id), F.when(F.col("group_id") == group_id, 0).otherwise(first))).over(doc)
    enough = F.count_if(own | (F.col("group_id") == group_id)).over(doc) >= 2
    joins = own & enough & F.col("group_id").isNull()
    new = {"__token": lead("token"), "__rest": F.lit(restoration) if restoration is not None else lead("restoration_text"), "__joins": F.coalesce(joins, F.lit(False))}
    out = entries.withColumns(new)
    take = F.col("__joins")
    return out.withColumns(
        {
            "group_backup_token": F.when(take, F.col("token")).otherwise(F.col("group_backup_token")), "group_backup_restoration": F.when(take, F.col("restoration_text")).otherwise(F.col("group_backup_restoration")),
            "token": F.when(take, F.col("__token")).otherwise(F.col("token")), "restoration_text": F.when(take, F.col("__rest")).otherwise(F.col("restoration_text")), "group_id": F.when(take, F.lit(group_id)).otherwise(F.col("group_id")),
        }
    ).select(*entries.columns)


def unlink(entries: DataFrame, entry_id: str | None = None, group_id: str | None = None) -> DataFrame:
    """Backups come back for a group, or for an entry; a group of two or fewer dissolves. Without backups nothing changes."""
    group = Window.partitionBy("doc_id", "group_id")
    hit = (F.col("group_id") == group_id) if group_id else (F.col("id") == entry_id)
    whole = F.lit(True) if group_id else F.count("*").over(group) <= 2
    leaves = F.col("group_id").isNotNull() & F.when(whole, F.max(hit).over(group)).otherwise(hit) & F.col("group_backup_token").isNotNull()
    out = entries.withColumn("__leaves", F.coalesce(leaves, F.lit(False)))
    back = lambda c, b: F.when(F.col("__leaves"), F.coalesce(b, c)).otherwise(F.col(c))
    gone = lambda c: F.when(F.col("__leaves"), F.lit(None)).otherwise(F.col(c))
    return out.withColumns({"token": back("token", "group_backup_token"), "restoration_text": back("restoration_text", "group_backup_restoration"), "group_id": gone("group_id"), "group_backup_token": gone("group_backup_token"), "group_backup_restoration": gone("group_backup_restoration")}).select(*entries.columns)


def group_numbers(entries: DataFrame) -> DataFrame:
    """(doc_id, group_id, number): the number in ids like ``related-3-x``; others go on after the largest, by first appearance."""
    groups = entries.where("group_id is not null").groupBy("doc_id", "group_id").agg(F.min("display_order").alias("first"))
    given = F.regexp_extract("group_id", "^related-([0-9]{1,9})-", 1).try_cast("int")
    doc = Window.partitionBy("doc_id")
    groups = groups.withColumn("given", given).withColumn("most", F.coalesce(F.max(given).over(doc), F.lit(0)))
    later = F.row_number().over(Window.partitionBy("doc_id", F.col("given").isNull()).orderBy("first", "group_id"))
    return groups.select("doc_id", "group_id", F.coalesce("given", F.col("most") + later).alias("number"))


# Documents of a session: doc_id, text, revision, lock_reason, response, mapping ------------------


def apply_normalized(docs: DataFrame, proposals: DataFrame, entries: DataFrame) -> DataFrame:
    """``proposals`` (doc_id, text, expected_revision) become the texts of documents that are still at that revision, are not
    locked, have no entries, and whose text changes by it. All others stay as they are."""
    new = proposals.select("doc_id", F.col("text").alias("__new"), F.col("expected_revision").alias("__expected"))
    used = entries.select("doc_id").distinct().withColumn("__used", F.lit(True))
    joined = docs.join(new, "doc_id", "left").join(used, "doc_id", "left")
    text = nfc(F.col("__new"))
    ok = F.col("__new").isNotNull() & (F.col("__expected") == F.col("revision")) & F.col("lock_reason").isNull() & F.col("__used").isNull() & ~F.col("text").eqNullSafe(text)
    joined = joined.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    out = joined.withColumn("text", F.when(F.col("__ok"), text).otherwise(F.col("text"))).withColumn("revision", F.when(F.col("__ok"), F.col("revision") + 1).otherwise(F.col("revision")))
    return out.select(*docs.columns)


def complete_detection(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (doc_id, outcome, candidates: a number, null outcome: merged by hand) locks documents against normalization: a lock
    stays; success is a completed detection; otherwise candidates, if there are any, are registered."""
    result = found.select("doc_id", F.col("outcome").alias("__outcome"), F.col("candidates").alias("__n"))
    reason = F.when(F.col("__outcome") == "success", "detection_completed").when(F.col("__n") > 0, "candidate_registered")
    return docs.join(result, "doc_id", "left").withColumn("lock_reason", F.coalesce("lock_reason", reason)).select(*docs.columns)


def set_response(docs: DataFrame, responses: DataFrame) -> DataFrame:
    """``responses`` (doc_id, response), in NFC, become the documents' responses."""
    new = responses.select("doc_id", nfc(F.col("response")).alias("__response"), F.lit(True).alias("__given"))
    return docs.join(new, "doc_id", "left").withColumn("response", F.when(F.col("__given"), F.col("__response")).otherwise(F.col("response"))).select(*docs.columns)


def load_mapping(docs: DataFrame, mapping: dict) -> DataFrame:
    """Documents with a saved mapping: its entries counted on each text, which one it is and its fingerprint, and the lock."""
    from ..sources.mappings import fingerprint

    about = F.struct(*[F.lit(mapping[k]).alias(k) for k in ("mappingId", "name", "createdAt", "updatedAt", "revision")], F.lit(fingerprint(mapping["entries"], mapping["mode"])).alias("fingerprint"))
    return reapply(docs, mapping).withColumn("mapping", about).withColumn("lock_reason", F.lit("candidate_registered"))


def clear(docs: DataFrame) -> DataFrame:
    """Documents of sessions that begin anew: no text, no response, no lock, no mapping."""
    first = {"text": F.lit(""), "revision": F.lit(0), "lock_reason": F.lit(None), "response": F.lit(""), "mapping": F.lit(None)}
    return docs.select(*[first[c].cast(docs.schema[c].dataType).alias(c) if c in first else F.col(c) for c in docs.columns])


def maskable(entries: DataFrame, docs: DataFrame, mode: str = "contextual") -> DataFrame:
    """``entries`` with maskable_count: how often each is masked in its document's text; 0 if it isn't active.

    That is the number of its occurrences, but for one-character surnames that are common words too: only these rows are
    looked at in Python.
    """
    from .masking import maskable_count

    @F.pandas_udf("int")
    def contextual(texts: pd.Series, values: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series([maskable_count(t or "", {"original_text": v, "category": "PERSON", "sources": list(s)}, mode) for t, v, s in zip(texts, values, sources)])

    joined = entries.join(docs.select("doc_id", F.col("text").alias("__text")), "doc_id", "left")
    doubtful = F.lit(mode == "contextual") & (F.col("category") == "PERSON") & F.col("original_text").isin(*AMBIGUOUS) & ~F.array_contains("sources", "manual") & ~F.array_contains("sources", "ner")
    n = F.when(doubtful, contextual("__text", "original_text", "sources")).otherwise(occurrences(F.coalesce("__text", F.lit("")), F.col("normalized_text")))
    return joined.withColumn("maskable_count", F.when(is_active(), n).otherwise(0)).drop("__text")


# Ranges ---------------------------------------------------------------------------------


def coalesce_ranges(ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end) with touching and overlapping ranges of a key as one: gaps and islands.

    Null ranges come last, and go with a key's last range; a key that has no other keeps each. Equal ranges are one, as both
    windows see them in the same order.
    """
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int"))
    grouped = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def merge_summary(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Per document: distinct candidate strings (doc_id, text) that are new, and that an entry has already."""
    known = entries.select("doc_id", F.col("normalized_text").alias("text"), F.lit(1).alias("known")).distinct()
    each = found.select("doc_id", "text").distinct().join(known, ["doc_id", "text"], "left")
    return each.groupBy("doc_id").agg(F.count_if(F.col("known").isNull()).alias("added"), F.count_if(F.col("known").isNotNull()).alias("merged"))


def next_group_number(entries: DataFrame) -> DataFrame:
    """(doc_id, number) that a new group gets."""
    return group_numbers(entries).groupBy("doc_id").agg((F.max("number") + 1).alias("number"))


def reapply(docs: DataFrame, mapping: dict) -> DataFrame:
    """A saved mapping (validated: at most 10,000 entries) on documents, as their ``entries``, counted anew."""
    from ..sources.mappings import reapply as on_text
    from ..sources.mappings import validate
    from .pipeline import ENTRY_DDL

    validate(mapping)

    @F.pandas_udf(ENTRY_DDL)
    def run(texts):
        return texts.map(lambda t: on_text(mapping, t or ""))

    return docs.withColumn("entries", run("text"))
