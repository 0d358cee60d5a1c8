"""Small listings of the stored tables: customers, carriers, invoices, feedback, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S


def by_name(rows: DataFrame, name: str, key: str) -> DataFrame:
    """All rows in order of name; equal names in order of key."""
    return rows.orderBy(name, key)


def by_key(rows: DataFrame, key: str, value: int) -> DataFrame:
    return rows.where(F.col(key) == value)


def with_text(invoices: DataFrame, text_column: str = "text") -> DataFrame:
    """Invoices whose text is not empty."""
    return invoices.where(F.col(text_column).isNotNull() & (F.col(text_column) != ""))


def unprocessed(feedback: DataFrame) -> DataFrame:
    """Feedback that nothing was learned from yet, the oldest first."""
    return feedback.where(~F.coalesce("is_processed", F.lit(False))).orderBy("created_at", "id")


def newest_first(lines: DataFrame) -> DataFrame:
    """Line feedback, the newest first."""
    return lines.orderBy(F.desc("created_at"), F.desc("id"))


def invoice_list(invoices: DataFrame) -> DataFrame:
    """The columns of the invoice list."""
    return invoices.select("doc_id", "invoice_number", "carrier_name", "carrier_account", "invoice_date", "invoice_due_dtm", "end_bal")


def with_parties(invoices: DataFrame, carriers: DataFrame, customers: DataFrame) -> DataFrame:
    """Invoices with the names of their carrier and customer, null for unknown keys. Both are dimensions of one row per
    key; Spark broadcasts them where their size allows it and else joins by key."""
    c = carriers.select("carrier_id", "carrier_name")
    return invoices.join(c, "carrier_id", "left").join(customers.select("customer_id", "customer_name"), "customer_id", "left")


def target_tables(rules: DataFrame) -> DataFrame:
    return rules.select("target_table").distinct()


def rules_of_targets(rules: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored rules whose carrier and target table a batch of learned rules touches."""
    return rules.join(batch.select("carrier_id", "target_table").distinct(), ["carrier_id", "target_table"], "left_semi")


def visible_total(cells: DataFrame, term: str = "", id_column: str = "doc_id") -> DataFrame:
    """Sum of the amounts, as text, of rows that hold the term in any cell, whatever the case; what is no number is 0."""
    words = F.lower(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in cells.columns if c != id_column]))
    shown = cells.where(F.contains(words, F.lit(term.lower())))
    return shown.groupBy(id_column).agg(F.count("*").alias("n"), F.sum(F.coalesce(S.money(F.col("amount").cast("string")), F.lit(0))).cast(S.MONEY).alias("total"))


def search(cells: DataFrame, term: str) -> DataFrame:
    """Rows of a grid that hold the term in any cell, whatever the case."""
    hit = F.lit(False)
    for c in cells.columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(term.lower()))
    return cells.where(hit)


def tallies(feedback: DataFrame, learned: DataFrame) -> DataFrame:
    """One row: how many pieces of feedback were processed and how many rules they gave."""
    seen = feedback.select(F.col("id").alias("feedback_id"), F.lit(1).alias("p"), F.lit(0).alias("r"))
    rules = learned.join(seen.select("feedback_id"), "feedback_id", "left_semi").select("feedback_id", F.lit(0).alias("p"), F.lit(1).alias("r"))
    both = seen.unionByName(rules)
    return both.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("processed"), F.coalesce(F.sum("r"), F.lit(0)).alias("rules_generated"))
