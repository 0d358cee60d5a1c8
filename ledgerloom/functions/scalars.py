"""Scalar column functions: text keys, money, dates, units, maps and JSON. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
WIDE = "decimal(28,6)"

#: The closed set of summary fields and their kinds (fixed values).
SUMMARY_FIELDS = {
    "invoice_number": "string",
    "carrier_account": "string",
    "invoice_date": "date",
    "invoice_st_dtm": "date",
    "invoice_end_dtm": "date",
    "invoice_due_dtm": "date",
    "beg_bal": "decimal",
    "payment": "decimal",
    "prev_adj": "decimal",
    "curr_adj": "decimal",
    "curr_chg": "decimal",
    "curr_tax": "decimal",
    "end_bal": "decimal",
}

DISPLAY_NAMES = {
    "invoice_number": "Invoice Number",
    "carrier_account": "Account Number",
    "invoice_date": "Invoice Date",
    "invoice_st_dtm": "Period Start",
    "invoice_end_dtm": "Period End",
    "invoice_due_dtm": "Due Date",
    "beg_bal": "Beginning Balance",
    "payment": "Payment",
    "prev_adj": "Previous Adjustment",
    "curr_adj": "Current Adjustment",
    "curr_chg": "Current Charges",
    "curr_tax": "Taxes",
    "end_bal": "Ending Balance",
}

#: Patterns, after commas are taken out, and the formats that read them.
_DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2} \d{4}$", "MMMM d yyyy"),
)
#: Two-digit years from this one on belong to the 1900s.
PIVOT = 50


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often the expression names it."""
    return F.transform(F.array(value), use)[0]


def blank(x: Column | str) -> Column:
    """Null, empty or white space only."""
    return trimmed(x).isNull()


def trimmed(x: Column | str) -> Column:
    """Without white space at both ends, Unicode spaces too; null if nothing is left."""
    return let(F.regexp_replace(col(x), r"(?U)^\s+|\s+$", ""), lambda v: F.when(v != "", v))


def found(text: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of a pattern's first match, trimmed; null without a match."""
    return trimmed(F.regexp_extract(col(text), pattern, group))


def first_of(*candidates: Column) -> Column:
    return F.coalesce(*candidates)


# ---------------------------------------------------------------------------------------------- text
def lookup_text(x: Column | str) -> Column:
    """Lower case, letters digits and spaces only, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(x)), r"[^a-z0-9\s]", ""), r"\s+", " "))


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - Levenshtein distance / longer length; two empty texts are equal, one empty text is unlike any other."""
    a, b = col(a), col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def account_key(x: Column | str) -> Column:
    return F.regexp_replace(col(x), "[^A-Za-z0-9]", "")


def comparable(x: Column | str) -> Column:
    """For comparing values: without dollar signs, commas and spaces, in lower case; null as empty."""
    return F.lower(F.translate(F.coalesce(col(x), F.lit("")), "$, ", ""))


def agrees(a: Column | str, b: Column | str) -> Column:
    """Equal, or one contains the other, in lower case with spaces collapsed; blank values agree with nothing."""
    a, b = (F.lower(F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\s+", " "))) for x in (a, b))
    return (a != "") & (b != "") & ((a == b) | F.contains(a, b) | F.contains(b, a))


def regex_escape(x: Column | str) -> Column:
    """A pattern that matches the text literally, any run of spaces for a space."""
    escaped = F.regexp_replace(col(x), r"([\\\\.\^$|?*+()\[\]{}#-])", r"\\$1")
    return F.regexp_replace(escaped, r"\s+", r"\\s+")


def without_parens(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"\(.*?\)", "")


def csv_field(x: Column | str) -> Column:
    """Quoted if it holds a comma, quote or line end."""
    x = F.coalesce(col(x), F.lit(""))
    return F.when(F.regexp_like(x, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def tsv_field(x: Column | str) -> Column:
    """Tabs, line ends and no-break spaces become one space."""
    return F.trim(F.regexp_replace(F.coalesce(col(x).cast("string"), F.lit("")), "[\t\r\n ]+", " "))


def tsv_lines(x: Column | str) -> Column:
    """``tsv_field`` of every line of a text, all at once."""
    text = F.regexp_replace(F.coalesce(col(x).cast("string"), F.lit("")), "[\t\r\u00a0]+", " ")
    return F.trim(F.regexp_replace(text, "\n +| +\n *", "\n"))


def context(text: Column | str, at: Column, size: Column, around: int = 120, most: int = 360) -> Column:
    """Characters around a place (from 1), spaces collapsed, at most ``most``."""
    begin = F.greatest(at - around, F.lit(1))
    piece = F.substring(col(text), begin, at + size + around - begin)
    return F.left(F.trim(F.regexp_replace(piece, r"\s+", " ")), F.lit(most))


def display_name(field: Column | str) -> Column:
    names = F.create_map(*[F.lit(x) for pair in DISPLAY_NAMES.items() for x in pair])
    return F.coalesce(names[col(field)], col(field))


# ---------------------------------------------------------------------------------------------- money
def money(x: Column | str) -> Column:
    """A decimal from text: ``$ , ( ) CR`` and inner minus signs go; only a leading minus negates; null if no number."""


    def read(raw: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(raw, "(?i)cr", ""), r"[$,()\s-]", "")
        value = let(bare, lambda b: F.when(F.regexp_like(b, F.lit(r"^[0-9]*\.?[0-9]*$")), b.try_cast(WIDE)))
        return F.when(raw.startswith("-"), F.lit(-1)).otherwise(F.lit(1)) * value

    return let(trimmed(x), lambda raw: read(raw).cast(WIDE))


def signed_money(x: Column | str) -> Column:
    """Like ``money``, but CR, parentheses and a leading minus all negate; null counts as zero."""


    def read(raw: Column) -> Column:
        negative = F.regexp_like(raw, F.lit(r"(?i)cr\s*$|^\$?\(.*\)|^\$?\s*-|^-"))
        return (F.when(negative, F.lit(-1)).otherwise(F.lit(1)) * F.abs(money(raw))).cast(WIDE)

    return F.coalesce(let(trimmed(x), read), F.lit(0).cast(WIDE))


def money_text(x: Column) -> Column:
    """Two decimals, half away from zero."""
    return F.round(x, 2).cast(MONEY).cast("string")


def clean_money(x: Column | str) -> Column:
    """Two decimals if the text is a number, else the text."""
    return F.coalesce(money_text(money(x)), col(x))


def clean_cost(x: Column | str) -> Column:
    raw = F.coalesce(trimmed(F.translate(col(x), "$,", "")), F.lit("--"))
    return F.when(raw == "--", F.lit("0.00")).otherwise(raw)


def limit_text(x: Column | str) -> Column:
    """Blank, ``--`` and unlimited become -1; commas go."""
    raw = F.coalesce(trimmed(x), F.lit("--"))
    return F.when(F.lower(raw).isin("--", "unlimited"), F.lit("-1")).otherwise(F.replace(raw, F.lit(","), F.lit("")))


def to_gb(value: Column, unit: Column | str) -> Column:
    unit, value = F.lower(col(unit)), value.cast("decimal(28,10)")
    return (
        F.when(unit.startswith("kilo") | (unit == "kb"), value / F.lit(1048576))
        .when(unit.startswith("mega") | (unit == "mb"), value / F.lit(1024))
        .otherwise(value)
        .cast("decimal(28,3)")
    )


def decimal_or_zero(x: Column | str) -> Column:
    return F.coalesce(money(x), F.lit(0).cast(WIDE))


def scaled(x: Column, size: Column) -> Column:
    """A coordinate on the 0 to 1000 scale, clamped; 0 for a page without size."""
    return F.when(size <= 0, F.lit(0.0)).otherwise(F.least(F.greatest(x / size * 1000, F.lit(0.0)), F.lit(1000.0)))


# ---------------------------------------------------------------------------------------------- dates
def date(x: Column | str) -> Column:
    """A date from text in any known format; two-digit years pivot at PIVOT; null if none fits."""


    def read(raw: Column) -> Column:
        out = F.lit(None).cast("date")
        for pattern, form in reversed(_DATE_FORMATS):  # a pattern first, as a failed parse is costly
            out = F.when(F.regexp_like(raw, F.lit(pattern)), F.try_to_timestamp(raw, F.lit(form)).cast("date")).otherwise(out)
        short = let(
            F.try_to_timestamp(F.regexp_replace(raw, "-", "/"), F.lit("M/d/yy")).cast("date"),
            lambda d: F.when(F.year(d) >= 2000 + PIVOT, F.add_months(d, -1200)).otherwise(d),
        )
        return F.when(F.regexp_like(raw, F.lit(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2}$")), short).otherwise(out)

    return let(F.regexp_replace(trimmed(x), r"[\s,]+", " "), read)


def date_key(x: Column | str) -> Column:
    return F.date_format(date(x), "yyyy-MM-dd")


def date_variants(d: Column) -> Column:
    """The forms in which a date is looked for in text."""
    formats = ("MM/dd/yyyy", "M/d/yyyy", "MM/dd/yy", "M/d/yy", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy")
    return F.array(*[F.date_format(d, f) for f in formats])


def start_before(month_day: Column | str, end: Column) -> Column:
    """"Month d" in the year of ``end``, or in the year before if that were later than ``end``."""
    d = date(F.concat(trimmed(month_day), F.lit(", "), F.year(end).cast("string")))
    return F.when(d > end, F.add_months(d, -12)).otherwise(d)


def version_stamp(t: Column) -> Column:
    return F.date_format(t, "yyyyMMddHHmmss")


# ---------------------------------------------------------------------------------------------- arrays, maps, JSON
def text_lines(x: Column | str) -> Column:
    """Lines, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(col(x), "\n"), lambda s: F.trim(s)), lambda s: s != "")


def starts_with_any(x: Column, prefixes: Sequence[str]) -> Column:
    return F.regexp_like(x, F.lit("(?i)^(?:" + "|".join(prefixes) + ")"))


def map_get(m: Column, *keys: str) -> Column:
    """The first non-blank value among keys, whatever their case."""
    lower = F.map_from_entries(
        F.array_distinct(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    )
    return F.coalesce(*[trimmed(F.try_element_at(lower, F.lit(k.lower()))) for k in keys])


def json_map(x: Column | str) -> Column:
    """A map from a JSON object; null if it is not one."""
    return F.from_json(col(x), "map<string,string>")


def json_outer(x: Column | str, brackets: str = "{}") -> Column:
    """The outermost object or array of a reply, code fences and prose around it gone; null without one."""
    a, b = (("\\" + c) for c in brackets)
    return F.nullif(F.regexp_extract(col(x), f"(?s){a}.*{b}", 0), F.lit(""))
