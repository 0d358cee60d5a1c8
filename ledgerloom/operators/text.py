"""Text normalising and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S


def normalised(text: Column | str) -> Column:
    """Line ends as line feeds, runs of horizontal space as one space, lines trimmed, at most one blank line in a row,
    no blank lines at either end."""
    t = F.replace(F.coalesce(S.col(text), F.lit("")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, r"[\t\p{Zs}&&[^ ]][\t\p{Zs}]*| [\t\p{Zs}]+", " ")  # a single space is left alone
    t = F.replace(F.replace(t, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return S.let(F.regexp_replace(t, r"\n{3,}", "\n\n"), _trimmed)


def _trimmed(t: Column) -> Column:
    """Without white space at both ends; what stands before a last line end of another kind counts as an end. Reading up to
    the last character that is no white space costs far less than trying every run of white space."""
    other = t.endswith("\u0085") | t.endswith("\u2028") | t.endswith("\u2029")
    return F.when(other, F.regexp_replace(t, r"^\s+|\s+$", "")).otherwise(F.regexp_extract(t, r"(?s)^\s*(.*\S)", 1))


def lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, pos, line), blank lines left out; pos counts all lines from 0."""
    return docs.select(id_column, F.posexplode(F.split(F.col(text_column), "\n")).alias("pos", "line")).where(F.trim("line") != "")


def array_lines(text: Column | str) -> Column:
    """All lines of a text, trimmed, in order."""
    return F.transform(F.split(S.col(text), "\n"), lambda s: F.trim(s))




def pages_text(pages: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One text per document from pages (id, page, text): blank lines go, a blank line follows every page."""
    kept = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.regexp_replace(s, "\r+$", "")), lambda s: F.trim(s) != "")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("page", F.concat(kept, F.array(F.lit(""))).alias("l")))), lambda p: p["l"])
    return pages.groupBy(id_column).agg(F.array_join(F.flatten(rows), "\n").alias("text"))
