"""The short rule set (number, date, total, vendor) and its merge with model predictions by confidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import patterns as P
from ledgerloom.functions import scalars as S

FIELDS = ("invoice_no", "date", "total", "vendor")
#: Confidence of rules by field, least confidence of a model, gain when both agree (fixed values).
RULE_CONFIDENCE = {"invoice_no": 0.72, "date": 0.70, "total": 0.74, "vendor": 0.65}
MODEL_LEAST, AGREEMENT = 0.55, 0.05

_OVERLAYS: dict[str, dict[str, list[str]]] = {}


def register_overlay(vendor: str, patterns: Mapping[str, Sequence[str]]) -> None:
    """Further patterns of a vendor, tried after the common ones."""
    _OVERLAYS[vendor.lower()] = {k: list(v) for k, v in patterns.items()}


def first_meaningful_line(text: Column | str) -> Column:
    """The first line of 3 characters or more that is no heading, address or number; 200 characters."""
    lines = F.filter(F.transform(F.split(S.col(text), r"\n"), lambda s: F.trim(s)), lambda s: F.length(s) >= 3)
    good = F.filter(lines, lambda s: ~F.regexp_like(s, F.lit(P.NO_VENDOR)) & ~F.regexp_like(s, F.lit(r"^\d+[./-]")))
    return F.left(F.try_element_at(good, F.lit(1)), F.lit(200))


def extract(docs: DataFrame, text_column: str = "text", vendor: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """invoice_no, date, total and vendor of texts."""
    more = _OVERLAYS.get((vendor or "").lower(), {})
    base = {"invoice_no": P.BASIC_NUMBER, "date": P.BASIC_DATE, "total": P.BASIC_TOTAL}
    value = {k: S.first_of(*[S.found(text_column, p) for p in [*v, *more.get(k, [])]]) for k, v in base.items()}
    over = [S.found(text_column, p) for p in more.get("vendor", [])]
    value["vendor"] = S.first_of(*over, first_meaningful_line(text_column))
    return docs.select(*keep, *[value[f].alias(f) for f in FIELDS])


def merge(scores: DataFrame) -> DataFrame:
    """Rows (doc_id, field, ml_value, ml_conf, rule_value, rule_conf) in; value, confidence and source out.

    A rule without confidence has its field's. Values that agree gain AGREEMENT on both sides, at most 1. The model wins
    if it then reaches MODEL_LEAST and is not below the rule, or there is no rule; agreeing sides of equal confidence are
    HYBRID. Else the rule wins. A model below MODEL_LEAST without a rule stays at half its confidence. Without any value
    the value is empty and the confidence 0.
    """
    known = F.create_map(*[F.lit(x) for pair in RULE_CONFIDENCE.items() for x in pair])
    default = F.coalesce(known[F.col("field")], F.lit(0.6))
    rows = scores.select(
        "doc_id", "field", F.coalesce("ml_value", F.lit("")).alias("m"), F.coalesce("rule_value", F.lit("")).alias("r"), F.coalesce("ml_conf", F.lit(0.0)).alias("mc"),
        F.when(F.coalesce("rule_conf", F.lit(0.0)) <= 0, default).otherwise(F.col("rule_conf")).alias("rc"),
    )
    gain = lambda c: F.when(F.col("agree"), F.least(F.col(c) + AGREEMENT, F.lit(1.0))).otherwise(F.col(c)).alias(c)
    rows = rows.withColumn("agree", S.agrees("m", "r")).select("doc_id", "field", "m", "r", "agree", gain("mc"), gain("rc"))
    rule = F.col("r") != ""
    ml = (F.col("m") != "") & (F.col("mc") >= MODEL_LEAST) & ((F.col("mc") >= F.col("rc")) | ~rule)
    hybrid = ml & rule & F.col("agree") & (F.col("rc") >= F.col("mc"))
    weak = ~ml & ~rule & (F.col("m") != "")
    return rows.select(
        "doc_id", "field", F.when(ml | weak, F.col("m")).otherwise(F.col("r")).alias("value"),
        F.round(F.when(ml, F.col("mc")).when(rule, F.col("rc")).when(weak, F.col("mc") * 0.5).otherwise(0.0), 4).alias("confidence"),
        F.when(hybrid, "HYBRID").when(ml | weak, "ML").otherwise("RULE").alias("source"),
    )


def overall(merged: DataFrame) -> DataFrame:
    """One row per document: ML or RULE if all fields come from it, else HYBRID."""
    kinds = F.array_sort(F.collect_set("source"))
    tag = F.when(F.size(kinds) == 1, kinds[0]).when(F.size(kinds) == 0, F.lit("RULE")).otherwise(F.lit("HYBRID"))
    return merged.groupBy("doc_id").agg(tag.alias("source"))
