"""Charge lines of a bill, by sections, phones and circuits; validity; cleaning. One shuffle by document."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ledgerloom.functions import patterns as P
from ledgerloom.functions import scalars as S
from ledgerloom.operators.text import normalised

def like(c: Column | str, pattern: str) -> Column:
    return F.regexp_like(S.col(c), F.lit(pattern))


def charge_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, the kept columns, pos, charge_desc, amount, line, section): all charges of whole texts.

    Lines shorter than 4 characters and circuit lines hold nothing. Before the first section title there are no charges;
    a title that is a charge itself begins no section and is no charge either. A line "SUMMARY FOR" with a phone sets the
    phone of what follows, "MONTHLY USAGE FOR TELEPHONE" does where there is none, a phone's total ends it. Credits by
    CR, parentheses or minus are negative. Unit prices at the end of a description go; what begins like no charge, totals,
    payments and adjustments are left out. One shuffle, by document.
    """
    rows = docs.select(id_column, *keep, F.posexplode(F.split(normalised(text_column), "\n")).alias("pos", "s"))
    rows = rows.where((F.length("s") >= 4) & ~like("s", P.CIRCUIT_LINE))
    total, phone = like("s", P.PHONE_TOTAL), F.nullif(F.regexp_extract("s", P.PHONE, 0), F.lit(""))
    starts = lambda title: F.lower(F.left("s", F.lit(len(title)))) == title.lower()
    monthly, each = starts("MONTHLY USAGE FOR TELEPHONE"), starts("SUMMARY FOR")
    title = F.lit(None).cast("string")
    for name in reversed(P.SECTIONS):
        title = F.when(starts(name), F.lit(name)).otherwise(title)
    # what a line is, decided once
    kind = F.when(total, "total").when(each, "each").when(monthly, "monthly").when(like("s", P.TAX_SECTION), "tax").when(title.isNotNull(), "title")
    rows = rows.select(id_column, *keep, "pos", "s", kind.alias("kind"), title.alias("title"), like("s", P.CHARGE).alias("priced"), phone.alias("phone"))
    rows = rows.where("kind is not null or priced")
    by = Window.partitionBy(id_column).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sets = (F.col("kind") == "total") | (F.col("kind") == "each") & F.col("phone").isNotNull()
    head = F.when(F.col("kind") == "tax", F.lit("Taxes, Fees & Surcharges")).when((F.col("kind") == "title") & ~F.col("priced"), F.col("title"))
    rows = rows.select(
        "*",
        F.count(F.when(sets, 1)).over(by).alias("span"),  # lines from one setting of the phone to the next
        F.last(head, ignorenulls=True).over(by).alias("headed"),
        F.max(F.col("kind").isin("each", "monthly")).over(by).alias("by_phone"),
    )
    inside = Window.partitionBy(id_column, "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    given = F.when(F.col("kind").isin("each", "monthly"), F.col("phone"))
    section = F.coalesce("headed", F.when(F.col("by_phone"), F.lit("MONTHLY USAGE FOR TELEPHONE")))
    rows = rows.select("*", F.first(given, ignorenulls=True).over(inside).alias("line"), section.alias("section"))
    desc = F.trim(F.regexp_extract("s", P.CHARGE, 1))
    rows = rows.where("priced and section is not null and (kind is null)").withColumn("d", desc)
    skip = S.starts_with_any(F.col("s"), [re.escape(x) for x in P.SKIP_PREFIXES])
    noise = (F.length("d") <= 12) & like("d", P.NOISE)
    no_charge = skip | like("s", P.EXCLUDED) | like("s", P.SUMMARY_TOTAL) | noise | like("d", r"^\d{2}/\d{2}/\d{4}$") | like("d", "^" + P.PHONE)
    rows = rows.where((F.length("d") >= 3) & ~no_charge)
    token, credit = F.trim(F.regexp_extract("s", P.CHARGE, 2)), F.regexp_extract("s", P.CHARGE, 3) != ""
    value = S.money(token)
    amount = F.when((credit | token.startswith("(")) & (value > 0), -value).otherwise(value)
    desc = F.trim(F.regexp_replace("d", P.UNIT_PRICE, ""))
    rows = rows.select(id_column, *keep, "pos", desc.alias("charge_desc"), F.round(amount, 2).cast(S.MONEY).alias("amount"), "line", "section")
    return rows.where(F.length("charge_desc") >= 3)


def located(charges: DataFrame, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Charges whose ``line``, where it is null, is the circuit named last before the line that holds their description,
    or, for the charge found last before a circuit, that circuit.

    The charges of a document are looked for one after the other, each from the line after the one before; that walk has
    no closed form in SQL, so documents that name a circuit, and only they, go through an Arrow function.
    """
    text = normalised(text_column)
    named = docs.where(F.contains(F.lower(F.col(text_column)), F.lit("circuit"))).select(id_column, text.alias("_t")).where(like("_t", P.CIRCUIT)).select(id_column, F.split("_t", "\n").alias("_lines"))
    packed = charges.join(named.select(id_column), id_column, "left_semi").groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("pos", "charge_desc"))).alias("_c"))
    packed = packed.join(named, id_column)
    found = packed.select(id_column, F.explode(F.arrays_zip(F.col("_c.pos").alias("pos"), walked("_lines", F.col("_c.charge_desc")).alias("circuit"))).alias("x"))
    found = found.select(id_column, "x.pos", "x.circuit")
    return charges.join(found, [id_column, "pos"], "left").withColumn("line", F.coalesce("line", "circuit")).drop("circuit")


@F.pandas_udf(ArrayType(StringType()))
def walked(lines: pd.Series, wanted: pd.Series) -> pd.Series:
    """For each description of a document, in order, the circuit that it lies at, or null."""
    named, out = re.compile(P.CIRCUIT), []
    for text, charges in zip(lines, wanted, strict=True):
        at: list[str | None] = []
        circuit, low = None, [c.lower() for c in charges]
        for line in text:
            if m := named.search(line):
                circuit = m[1]
                if at and at[-1] is None:
                    at[-1] = circuit
            elif len(at) < len(low) and low[len(at)] in line.lower():
                at.append(circuit)
        out.append(at + [None] * (len(low) - len(at)))
    return pd.Series(out)


def deduplicated(charges: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The first charge of each description (in lower case), amount and line (in lower case) of a document."""
    key = [id_column, F.lower("charge_desc"), "amount", F.lower(F.coalesce("line", F.lit("")))]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("pos"))
    return charges.withColumn("_n", first).where("_n = 1").drop("_n")


def parse(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Charges of whole texts, extracted, deduplicated and located."""
    rows = located(deduplicated(charge_rows(docs, id_column, text_column), id_column), docs, id_column, text_column)
    return rows.withColumn("location", F.lit(None).cast("string"))  # this layout names none


# ---------------------------------------------------------------------------------------------- validity
def invalid(desc: Column | str) -> Column:
    """Blank, a web address, information, a disclaimer or a footer."""
    d = F.trim(S.col(desc))
    hits = [F.regexp_like(d, F.lit(p)) for p in (P.URL, P.INFORMATIONAL, P.DISCLAIMER, P.FOOTER)]
    out = S.blank(d)
    for h in hits:
        out = out | h
    return F.coalesce(out, F.lit(True))


def ambiguous(desc: Column | str) -> Column:
    """Long, or with two full stops or the like in a row, or soft words, or many words without a billing word; blank is
    not ambiguous."""
    d = F.trim(F.coalesce(S.col(desc), F.lit("")))
    wordy = ~F.regexp_like(d, F.lit(P.BILLING)) & (F.size(F.split(d, " ")) > 6)
    return (F.length(d) > 80) | F.regexp_like(d, F.lit(P.MARKS)) | F.regexp_like(d, F.lit(P.SOFT)) | wordy


def valid_patterns(patterns: Sequence[str], groups: int = 0) -> list[str]:
    """Patterns that compile and have that many groups at least; checked on the driver, so that no job fails."""
    from pyspark.sql import SparkSession

    out = []
    jvm = SparkSession.getActiveSession()._jvm
    for p in patterns:
        try:
            if p and jvm.java.util.regex.Pattern.compile(p).matcher("").groupCount() >= groups:
                out.append(p)
        except Exception:  # noqa: BLE001  the Java compiler's complaint
            continue
    return out


def skipped(desc: Column | str, patterns: Sequence[str]) -> Column:
    """Whether a learned skip pattern matches, whatever the case; bad patterns never match."""
    out = F.lit(False)
    for p in valid_patterns(patterns):
        out = out | F.regexp_like(S.col(desc), F.lit(f"(?i){p}"))
    return F.coalesce(out, F.lit(False))


def cleaned(desc: Column | str, patterns: Sequence[str]) -> Column:
    """The description with every pattern removed in order, trimmed; null if fewer than 3 characters are left."""
    d = S.col(desc)
    for p in valid_patterns(patterns):
        d = F.regexp_replace(d, f"(?i){p}", "")
    d = F.trim(d)
    return F.when(F.length(d) >= 3, d)


def without_rejected(charges: DataFrame, rejected: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Charges without those whose description a classifier rejected (rows id, charge_desc), whatever the case."""
    gone = rejected.select(F.col(id_column), F.lower("charge_desc").alias("_d")).distinct()
    return charges.withColumn("_d", F.lower("charge_desc")).join(gone, [id_column, "_d"], "left_anti").drop("_d")


def search(charges: DataFrame, term: str, columns: Sequence[str] = ("charge_desc", "line", "location")) -> DataFrame:
    """Rows that hold the term in one of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(term.lower()))
    return charges.where(hit)
