"""Totals, groups, reconciliation against stated totals, and accuracy of extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S

ZERO = F.lit


def charge_totals(charges: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Number of charges and their sum per document; a null amount counts as zero."""
    total = F.sum(F.coalesce(F.col("amount"), F.lit(0).cast(S.MONEY))).cast(S.MONEY)
    return charges.groupBy(id_column).agg(F.count("*").alias("n_charges"), total.alias("total"))


def group_charges(charges: DataFrame, by: str, id_column: str = "doc_id") -> DataFrame:
    """Count and subtotal per line or location in order of first appearance; blank ones together."""
    name = F.coalesce(S.trimmed(by), F.lit(f"(No {by.capitalize()})"))
    groups = charges.groupBy(id_column, name.alias("group_name")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("amount", F.lit(0).cast(S.MONEY))).cast(S.MONEY).alias("subtotal"), F.min("pos").alias("_p")
    )
    order = F.row_number().over(Window.partitionBy(id_column).orderBy("_p"))
    return groups.withColumn("group_order", order).drop("_p")


def charge_rollup(charges: DataFrame) -> DataFrame:
    """Subtotals by line and location with all totals above them (an extension)."""
    return charges.rollup("line", "location").agg(F.count("*").alias("n"), F.sum("amount").cast(S.MONEY).alias("subtotal"), F.grouping_id().cast("int").alias("level"))


def verdict(total: Column, charges: Column, tax: Column) -> Column:
    """hidden, ok, warning or danger, by how far the charges are from what is stated."""
    zero = F.lit(0).cast(S.MONEY)
    expected = F.coalesce(charges, zero) + F.coalesce(tax, zero)
    total = F.coalesce(total, zero)
    difference = F.abs(total - expected)
    share = F.when(expected <= 0, F.lit(100).cast("decimal(28,6)")).otherwise(difference * 100 / F.nullif(expected, zero))
    level = (
        F.when((total == 0) & (expected == 0), "hidden").when(difference <= F.lit("0.02").cast(S.MONEY), "ok").when(share > 20, "danger").otherwise("warning")
    )
    way = F.when(total < expected, "less").when(total > expected, "more").otherwise("equal")
    return F.struct(expected.cast(S.MONEY).alias("expected"), difference.cast(S.MONEY).alias("difference"), level.alias("level"), way.alias("way"))


def reconcile(bills: DataFrame, totals: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Each bill's stated current charges and taxes against the sum of its charges."""
    joined = bills.select(id_column, "curr_chg", "curr_tax").join(totals.select(id_column, "total"), id_column, "left")
    rows = joined.select(id_column, F.coalesce("total", F.lit(0).cast(S.MONEY)).alias("total"), verdict(F.col("total"), F.col("curr_chg"), F.col("curr_tax")).alias("v"))
    return rows.select(id_column, "total", "v.*")


def accuracy(pairs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Share of detected values that a person left unchanged: rows (id, kind, detected, confirmed) in, one per id out.

    Blank detected values do not count. Bands: high from 80 percent, medium from 50, else low.
    """
    seen = pairs.where(~S.blank("detected"))
    same = F.sum((S.comparable("detected") == S.comparable("confirmed")).cast("int"))
    out = seen.groupBy(id_column).agg(F.count("*").alias("detected"), same.alias("unchanged"))
    percent = F.floor(F.col("unchanged") * 100 / F.col("detected")).cast("int")
    band = F.when(percent >= 80, "high").when(percent >= 50, "medium").otherwise("low")
    return out.select(id_column, "detected", "unchanged", percent.alias("percent"), band.alias("band"))
