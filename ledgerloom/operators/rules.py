"""Learned rules: ordering, overlay, induction, verification, upsert, counters, and the diffs that feed them.

Rules are rows (id, carrier_id, field_name, regex_pattern, field_type, target_table, section, sort_order, is_active,
success_count, fail_count). Patterns are columns, so a rule table of any size is joined by carrier, not collected.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ledgerloom.functions import patterns as P
from ledgerloom.functions import scalars as S
from ledgerloom.operators import feedback as FB

SCHEMA = (
    "id int, carrier_id int, field_name string, regex_pattern string, field_type string, target_table string, section string, "
    "sort_order int, is_active boolean, success_count int, fail_count int"
)


def _first(text: str, pattern: str, group: int = 1) -> Column:
    """A group of the first match of a pattern column, whatever the case."""
    return F.expr(f"regexp_extract(`{text}`, concat('(?i)', `{pattern}`), {group})")


def ordered(rules: DataFrame, carrier_id: int | None = None) -> DataFrame:
    """Active rules (of one carrier) with ``rank``: best score first, then sort order, then id."""
    rows = rules.where("is_active")
    if carrier_id is not None:
        rows = rows.where(F.col("carrier_id") == carrier_id)
    order = Window.partitionBy("carrier_id").orderBy(F.desc(F.col("success_count") - F.col("fail_count")), "sort_order", "id")
    return rows.withColumn("rank", F.row_number().over(order))


def kind(rule_type: Column | str = "field_type", table: Column | str = "target_table") -> Column:
    """summary, charge or skip."""
    return F.when(S.col(rule_type) == "skip", "skip").when(S.col(table) == "t_charge", "charge").otherwise("summary")


def overlay(docs: DataFrame, rules: DataFrame, id_column: str = "doc_id", text_column: str = "text", best_wins: bool = True) -> DataFrame:
    """Rows (id, field, value) that the summary rules of each document's carrier find.

    Of several rules for a field that match, the best ranked wins (``best_wins``), or the last, as each match
    overwrites. Patterns must compile and have a group (see ``charges.valid_patterns``).
    """
    chosen = ordered(rules).where(kind() == "summary").select("carrier_id", "field_name", "regex_pattern", "rank")
    hits = docs.select(id_column, "carrier_id", F.col(text_column).alias("_t")).join(chosen, "carrier_id")
    hits = hits.withColumn("value", S.trimmed(_first("_t", "regex_pattern"))).where("value is not null")
    pick = F.min_by("value", "rank") if best_wins else F.max_by("value", "rank")
    return hits.groupBy(id_column, F.col("field_name").alias("field")).agg(pick.alias("value"))


def charge_overlay(lines: DataFrame, rules: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Charges that charge rules with two groups (description, amount) find in lines (id, carrier_id, pos, line)."""
    chosen = ordered(rules).where(kind() == "charge").select("carrier_id", "regex_pattern", "rank")
    hits = lines.join(chosen, "carrier_id")
    hits = hits.select(id_column, "pos", "rank", S.trimmed(_first("line", "regex_pattern")).alias("charge_desc"), S.money(_first("line", "regex_pattern", 2)).alias("amount"))
    return hits.where("charge_desc is not null and amount is not null").withColumn("amount", F.round("amount", 2).cast(S.MONEY))


def skip_filter(charges: DataFrame, rules: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Charges (id, carrier_id, charge_desc, ...) that no skip rule of their carrier matches; patterns must compile."""
    rows = charges.join(_by_carrier(rules, "_skips"), "carrier_id", "left")
    hit = F.exists("_skips", lambda p: F.regexp_like("charge_desc", F.concat(F.lit("(?i)"), p)))
    return rows.where(~F.coalesce(hit, F.lit(False))).select(charges.columns)


def _by_carrier(rules: DataFrame, name: str) -> DataFrame:
    """One row per carrier with an array of its skip patterns in order of rank. Arrays of one carrier's rules are small;
    joined as one row per carrier they neither multiply charges nor need a second join to drop the matches."""
    skips = ordered(rules).where(kind() == "skip")
    return skips.groupBy("carrier_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "regex_pattern"))), lambda x: x["regex_pattern"]).alias(name))


def skip_clean(charges: DataFrame, rules: DataFrame) -> DataFrame:
    """Charges (carrier_id, charge_desc, ...) with all their carrier's skip patterns taken out of the description, one
    after the other; those with fewer than 3 characters left are dropped. Blank descriptions stay. Patterns must compile."""
    rows = charges.join(_by_carrier(rules, "_skips"), "carrier_id", "left")
    cut = F.aggregate("_skips", F.col("charge_desc"), lambda d, p: F.trim(F.regexp_replace(d, F.concat(F.lit("(?i)"), p), F.lit(""))))
    rows = rows.withColumn("_d", F.when(F.col("_skips").isNotNull() & ~S.blank("charge_desc"), cut).otherwise(F.col("charge_desc")))
    kept = rows.where(F.col("_skips").isNull() | S.blank("charge_desc") | (F.length("_d") >= 3))
    return kept.withColumn("charge_desc", F.col("_d")).select(charges.columns)


# ---------------------------------------------------------------------------------------------- feedback to rules
def from_feedback(feedback: DataFrame) -> DataFrame:
    """Rows (feedback_id, carrier_id, field_name, regex_pattern, field_type, target_table) that feedback (id, carrier_id,
    feedback_text, pdf_text, original_fields_json, confirmed_fields_json) teaches: the label of a value that a sentence
    gives, skip patterns for text that a sentence wants gone, and the label of a confirmed value that differs from the
    original, for fields that a sentence names. Feedback without text or document teaches nothing."""
    given = feedback.where(~S.blank("feedback_text") & ~S.blank("pdf_text"))
    said = FB.sentences(given, "id", "feedback_text")
    said = said.select("id", "sentence", FB.field_of("sentence").alias("field"))
    number = F.replace(S.found("sentence", P.CORRECT_NUMBER), F.lit(","), F.lit(""))
    mentioned = said.where("field is not null")
    wanted = mentioned.select("id", "field", number.alias("value")).where("value is not null")
    texts = given.select("id", "carrier_id", "pdf_text", S.json_map("confirmed_fields_json").alias("_c"), S.json_map("original_fields_json").alias("_o"))
    fixed = mentioned.select("id", "field").distinct().join(texts.where("_c is not null and _o is not null"), "id")
    fixed = fixed.select("id", "field", F.try_element_at("_c", F.col("field")).alias("value"), F.try_element_at("_o", F.col("field")).alias("old"))
    fixed = fixed.where(~S.blank("value") & (S.comparable("value") != S.comparable("old"))).select("id", "field", "value")
    truth = wanted.unionByName(fixed).distinct()
    found = induce_all(texts.select("id", "pdf_text"), truth)
    kind_of = F.when(F.col("field").isin(*[k for k, v in S.SUMMARY_FIELDS.items() if v == "date"]), "date").when(F.col("field").isin("invoice_number", "carrier_account"), "string").otherwise("decimal")
    fields = found.select("id", F.col("field").alias("field_name"), F.col("pattern").alias("regex_pattern"), kind_of.alias("field_type"), F.lit("t_invoice").alias("target_table"))
    noise = said.select("id", FB.noise_pattern("sentence").alias("regex_pattern")).where("regex_pattern is not null")
    noise = noise.select("id", F.lit("charge_skip_pattern").alias("field_name"), "regex_pattern", F.lit("skip").alias("field_type"), F.lit("t_charge").alias("target_table"))
    rows = fields.unionByName(noise).distinct().join(given.select("id", "carrier_id"), "id")
    return rows.select(F.col("id").alias("feedback_id"), "carrier_id", "field_name", "regex_pattern", "field_type", "target_table")


def induce_all(docs: DataFrame, truth: DataFrame) -> DataFrame:
    """``induce`` for documents (id, pdf_text) and several values of a field: each value on its own."""
    keyed = truth.withColumn("_k", F.concat_ws("\u0001", F.col("id").cast("string"), "value"))
    texts = keyed.select("id", "_k").distinct().join(docs, "id").select(F.col("_k").alias("doc_id"), F.col("pdf_text").alias("text"))
    found = induce(texts, keyed.select(F.col("_k").alias("doc_id"), "field", "value"))
    return found.join(keyed.select(F.col("_k").alias("doc_id"), "id").distinct(), "doc_id").select("id", "field", "value", "pattern").distinct()


def from_reply(replies: DataFrame) -> DataFrame:
    """Rows (feedback_id, carrier_id, field_name, regex_pattern, field_type, target_table, sort_order) from a language
    model's replies (id, carrier_id, pdf_text, reply): a JSON array, with fences or prose around it; patterns must compile
    and their first match in the document must capture 1 to 500 characters."""
    items = F.from_json(S.json_outer("reply", "[]"), "array<struct<fieldName:string,regexPattern:string,targetTable:string,fieldType:string>>")
    rows = replies.select("id", "carrier_id", "pdf_text", F.posexplode(items).alias("n", "x"))
    rows = rows.select(
        F.col("id").alias("feedback_id"), "carrier_id", "pdf_text", F.col("x.fieldName").alias("field_name"), F.col("x.regexPattern").alias("regex_pattern"),
        F.coalesce("x.fieldType", F.lit("string")).alias("field_type"), F.coalesce("x.targetTable", F.lit("t_invoice")).alias("target_table"), "n",
    ).where(~S.blank("field_name") & ~S.blank("regex_pattern"))
    rows = rows.where(captures("pdf_text", "regex_pattern")).drop("pdf_text")
    place = F.row_number().over(Window.partitionBy("feedback_id").orderBy("n")) + 49
    return rows.withColumn("sort_order", place.cast("int")).drop("n")


@F.pandas_udf(BooleanType())
def captures(text: pd.Series, pattern: pd.Series) -> pd.Series:
    """Whether a pattern compiles and its first match captures 1 to 500 characters; a bad pattern is no failure here,
    which a built-in function on a column of patterns would make it."""
    out = []
    for t, p in zip(text, pattern, strict=True):
        try:
            m = re.compile(p, re.IGNORECASE | re.DOTALL).search(t or "")
            out.append(bool(m and m.re.groups and m[1] and 0 < len(m[1].strip()) <= 500))
        except re.error:
            out.append(False)
    return pd.Series(out)


def learn(feedback: DataFrame, stored: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole loop on unprocessed feedback: (stored rules afterwards, learned rules, feedback marked as processed).

    model: a port that gives replies (id, carrier_id, pdf_text, reply) for feedback that taught nothing by its text."""
    todo = feedback.where(~F.coalesce("is_processed", F.lit(False)))
    learned = from_feedback(todo)
    if model is not None:
        mute = todo.join(learned.select(F.col("feedback_id").alias("id")).distinct(), "id", "left_anti")
        learned = learned.unionByName(from_reply(model(mute)).drop("sort_order"))
    return upsert(stored, learned.drop("feedback_id")), learned, mark_processed(feedback, todo.select("id"))


def mark_processed(feedback: DataFrame, ids: DataFrame) -> DataFrame:
    """The feedback table with ``is_processed`` set for the ids, one or many."""
    done = ids.select("id").distinct().withColumn("_done", F.lit(True))
    rows = feedback.join(done, "id", "left")
    return rows.withColumn("is_processed", F.coalesce("_done", F.coalesce("is_processed", F.lit(False)))).select(feedback.columns)


# ---------------------------------------------------------------------------------------------- induction
def capture(field: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in P.CAPTURE.items() for x in pair])
    return F.coalesce(known[S.col(field)], F.lit(P.CAPTURE_MONEY))


def induce(docs: DataFrame, truth: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, field, value, pattern): for each confirmed value the pattern of the label to its left.

    Labels have 3 characters or more, two letters among them. A pattern counts only if its first match in the whole
    text gives the value. The longest label wins, the earliest on ties.
    """
    values = truth.where(~S.blank("value")).select(id_column, "field", S.trimmed("value").alias("value"))
    lines = docs.select(id_column, F.col(text_column).alias("_t"), F.posexplode(F.split(text_column, "\n")).alias("pos", "line"))
    near = lines.join(values, id_column).where(F.contains("line", F.col("value")))
    label = F.trim(F.expr("substring(line, 1, instr(line, value) - 1)"))
    near = near.withColumn("label", F.regexp_replace(label, r"[\s$]+$", "")).where((F.length("label") >= 3) & F.regexp_like("label", F.lit("[A-Za-z].*[A-Za-z]")))
    near = near.withColumn("pattern", F.concat(S.regex_escape("label"), F.lit(r"\s*\$?\s*"), capture("field")))
    near = near.where(S.trimmed(_first("_t", "pattern")) == F.col("value"))
    best = F.row_number().over(Window.partitionBy(id_column, "field").orderBy(F.desc(F.length("label")), "pos"))
    return near.withColumn("_n", best).where("_n = 1").select(id_column, "field", "value", "pattern")


def upsert(rules: DataFrame, learned: DataFrame) -> DataFrame:
    """The rule table after learned rules (carrier_id, field_name, regex_pattern, field_type, target_table) came in.

    An equal rule gains a success; a rule of the same field takes the new pattern, starts again at 1 success and is
    active; else the rule is new. Skip rules are never replaced. Equal rules of a batch count once; of several for a
    field the last in order of pattern stays.
    """
    same = ["carrier_id", "field_name", "target_table"]
    batch = learned.dropDuplicates([*same, "regex_pattern", "field_type"])
    skip, plain = batch.where("field_type = 'skip'"), batch.where("field_type <> 'skip'")
    last = F.row_number().over(Window.partitionBy(*same).orderBy(F.desc("regex_pattern")))
    plain = plain.withColumn("_n", last).where("_n = 1").drop("_n")
    old, held = rules.where("field_type <> 'skip'"), rules.where("field_type = 'skip'")
    n = plain.select(*same, F.col("regex_pattern").alias("np"), F.col("field_type").alias("nt"))
    joined = old.join(n, same, "full")
    equal, fresh = F.col("np") == F.col("regex_pattern"), F.col("id").isNull()
    changed = F.col("np").isNotNull() & ~fresh & ~F.coalesce(equal, F.lit(False))
    plain_out = joined.select(
        "id", *same, F.coalesce("np", "regex_pattern").alias("regex_pattern"), F.coalesce("field_type", "nt").alias("field_type"),
        F.when(fresh | changed, 1).when(equal, F.col("success_count") + 1).otherwise(F.col("success_count")).alias("success_count"),
        F.when(fresh | changed, 0).otherwise(F.col("fail_count")).alias("fail_count"),
        F.when(fresh | changed, True).otherwise(F.col("is_active")).alias("is_active"),
    )
    s = skip.select(*same, "regex_pattern", F.lit(True).alias("_hit"))
    skips = held.join(s, [*same, "regex_pattern"], "full")
    skip_out = skips.select(
        "id", *same, "regex_pattern", F.lit("skip").alias("field_type"),
        F.when(F.col("id").isNull(), 1).otherwise(F.col("success_count") + F.coalesce("_hit", F.lit(False)).cast("int")).alias("success_count"),
        F.coalesce("fail_count", F.lit(0)).alias("fail_count"), F.coalesce("is_active", F.lit(True)).alias("is_active"),
    )
    return plain_out.unionByName(skip_out)


def count_feedback(rules: DataFrame, confirmed: DataFrame, corrected: DataFrame) -> DataFrame:
    """Counters after a review: a success for rules of confirmed fields (carrier_id, field_name), else a failure for
    rules of corrected fields."""
    key = ["carrier_id", "field_name"]
    good = confirmed.select(*key).distinct().withColumn("_g", F.lit(True))
    bad = corrected.select(*key).distinct().withColumn("_b", F.lit(True))
    rows = rules.join(good, key, "left").join(bad, key, "left")
    won, lost = F.col("_g").isNotNull(), F.col("_g").isNull() & F.col("_b").isNotNull()
    return rows.withColumns({"success_count": F.col("success_count") + won.cast("int"), "fail_count": F.col("fail_count") + lost.cast("int")}).drop("_g", "_b")


# ---------------------------------------------------------------------------------------------- diffs
def field_diff(original: DataFrame, confirmed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Rows (id, field, original, confirmed, status) of long forms, all fields of either: confirmed, corrected, or
    unconfirmed where the confirmation is blank or missing."""
    joined = confirmed.select(id_column, "field", F.col("value").alias("confirmed")).join(
        original.select(id_column, "field", F.col("value").alias("original")), [id_column, "field"], "full"
    )
    same = S.comparable("original") == S.comparable("confirmed")
    status = F.when(S.blank("confirmed"), "unconfirmed").when(same, "confirmed").otherwise("corrected")
    return joined.select(id_column, "field", "original", "confirmed", status.alias("status"))


def charge_diff(original: DataFrame, submitted: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Charges compared by position: unchanged, corrected, deleted or added."""
    o = original.select(id_column, "pos", F.col("charge_desc").alias("old_desc"), F.col("amount").alias("old_amount"))
    n = submitted.select(id_column, "pos", F.col("charge_desc").alias("new_desc"), F.col("amount").alias("new_amount"))
    same = F.col("old_desc").eqNullSafe(F.col("new_desc")) & F.col("old_amount").eqNullSafe(F.col("new_amount"))
    status = F.when(F.col("new_desc").isNull(), "deleted").when(F.col("old_desc").isNull(), "added").when(same, "unchanged").otherwise("corrected")
    return o.join(n, [id_column, "pos"], "full").withColumn("status", status)


def diff_skips(diff: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Skip patterns that a person's changes show: text removed before, after or around what stayed (3 characters or
    more), and the whole text of deleted charges."""
    old, new = F.col("old_desc"), F.col("new_desc")
    place = F.expr("instr(old_desc, new_desc)")
    before = F.trim(F.expr("substring(old_desc, 1, instr(old_desc, new_desc) - 1)"))
    after = F.trim(F.expr("substring(old_desc, instr(old_desc, new_desc) + length(new_desc))"))
    kept = (F.col("status") == "corrected") & (old != new) & (F.length(F.trim(new)) > 0) & (place > 0)
    found = F.when(kept, F.array(before, after)).when(F.col("status") == "deleted", F.array(F.trim(old))).otherwise(F.array().cast("array<string>"))
    rows = diff.select(id_column, F.explode(found).alias("removed")).where(F.length("removed") >= 3)
    return rows.select(id_column, "removed", S.regex_escape("removed").alias("pattern")).distinct()
