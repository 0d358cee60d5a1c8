"""Free-text feedback, confirmed values, fuzzy lookup of labelled lines, duplicates, replies of language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import patterns as P
from ledgerloom.functions import scalars as S


def sentences(feedback: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows (id, pos, sentence): split at white space after . ! ? and at line ends, longer than 3 characters."""
    parts = F.transform(F.split(text_column, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s))
    return feedback.select(id_column, F.posexplode(parts).alias("pos", "sentence")).where(F.length("sentence") > 3)


def field_of(sentence: Column | str, longest: bool = True) -> Column:
    """The summary field that a sentence names: by the longest alias in it, or by the first in the fixed order."""
    text, aliases = F.lower(S.col(sentence)), list(P.ALIASES)
    if longest:
        aliases.sort(key=lambda a: -len(a[0]))
    out = F.lit(None).cast("string")
    for alias, name in reversed(aliases):
        out = F.when(F.contains(text, F.lit(alias)), F.lit(name)).otherwise(out)
    return out


def correction(sentence: Column | str, field: Column | str) -> Column:
    """The value that a sentence asks for: a date for dates, the next token for numbers and accounts, else a number
    without commas; a number too where no date or token is found."""
    kind = S.col(field)
    is_date = kind.isin(*[k for k, v in S.SUMMARY_FIELDS.items() if v == "date"])
    is_text = kind.isin(*[k for k, v in S.SUMMARY_FIELDS.items() if v == "string"])
    number = F.replace(S.found(sentence, P.CORRECT_NUMBER), F.lit(","), F.lit(""))
    return F.coalesce(F.when(is_date, S.date_key(S.found(sentence, P.CORRECT_DATE))), F.when(is_text, S.found(sentence, P.CORRECT_TEXT)), number)


def noise_pattern(sentence: Column | str) -> Column:
    """A skip pattern for the phrase that a sentence wants gone, of 3 characters or more."""
    phrase = S.found(sentence, P.NOISE_PHRASE)  # what follows until a full stop, comma or the end
    return F.when(F.length(phrase) >= 3, S.regex_escape(phrase))


def corrections(feedback: DataFrame, id_column: str = "id", text_column: str = "feedback_text") -> DataFrame:
    """Rows (id, field, value): the first correction of each field."""
    rows = sentences(feedback, id_column, text_column).select(id_column, "pos", field_of("sentence").alias("field"), "sentence")
    rows = rows.withColumn("value", S.trimmed(correction("sentence", "field")))
    first = F.min_by("value", "pos").alias("value")
    return rows.where("field is not null and value is not null").groupBy(id_column, "field").agg(first)


def newest_confirmed(bills: DataFrame, feedback: DataFrame, most: int = 800, id_column: str = "doc_id") -> DataFrame:
    """For each bill (id, carrier_id, carrier_account, invoice_date) the fields of the newest feedback with the same
    account and date, among the carrier's newest ``most``. Feedback whose JSON is no object is skipped."""
    newest = F.row_number().over(Window.partitionBy("carrier_id").orderBy(F.desc("created_at"), F.desc("id")))
    f = feedback.withColumn("_n", newest).where(F.col("_n") <= most).withColumn("fields", S.json_map("confirmed_fields_json")).where("fields is not null")
    f = f.select("carrier_id", "created_at", "id", "fields", S.account_key(S.map_get(F.col("fields"), "carrier_account")).alias("_a"), S.date_key(S.map_get(F.col("fields"), "invoice_date")).alias("_d"))
    b = bills.select(F.col(id_column).alias("_doc"), F.col("carrier_id"), S.account_key("carrier_account").alias("_a"), S.date_key("invoice_date").alias("_d"))
    hits = b.join(f, ["carrier_id", "_a", "_d"]).where("_a <> ''")
    best = F.max_by(F.struct("id", "fields"), F.struct("created_at", "id")).alias("b")
    return hits.groupBy(F.col("_doc").alias(id_column)).agg(best).select(id_column, F.col("b.id").alias("feedback_id"), F.col("b.fields").alias("fields"))


def confirmed_overlay(parsed: DataFrame, confirmed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Long form with confirmed values in front of parsed ones; unknown fields and blank values are ignored."""
    rows = confirmed.select(id_column, F.explode("fields").alias("field", "value")).where(F.col("field").isin(*S.SUMMARY_FIELDS) & ~S.blank("value"))
    rows = rows.select(id_column, "field", "value", F.lit("confirmed").alias("source"))
    return rows.unionByName(parsed.select(id_column, "field", "value", "source").join(rows, [id_column, "field"], "left_anti"))


def duplicates(bills: DataFrame, saved: DataFrame) -> DataFrame:
    """Bills whose number and carrier are saved already; numbers compare in lower case, null carriers are equal."""
    s = saved.where(~S.blank("invoice_number")).select(F.lower("invoice_number").alias("_n"), F.col("carrier_id").alias("_c")).distinct()
    return bills.join(s, (F.lower("invoice_number") == F.col("_n")) & F.col("carrier_id").eqNullSafe(F.col("_c")), "left_semi")


def fuzzy_lookup(lines: DataFrame, labelled: DataFrame, least: float = 0.8, id_column: str = "doc_id") -> DataFrame:
    """Rows (id, pos, line, label, similarity): an equal labelled line, else the nearest at ``least`` or more.

    labelled: rows (text, label, created_at); of equal normalised texts the newest counts. Texts that are near enough
    have lengths within a factor of ``least``; lines meet labelled texts by length only, and each distinct text once.
    """
    key = S.lookup_text("text")
    known = labelled.select(key.alias("k"), "label", "created_at").where("k <> ''").groupBy("k").agg(F.max_by("label", "created_at").alias("label"))
    texts = lines.select(S.lookup_text("line").alias("t")).where("t <> ''").distinct()
    exact = texts.join(known.select(F.col("k").alias("t"), "label"), "t").select("t", "label", F.lit(1.0).alias("similarity"))
    rest = texts.join(exact.select("t"), "t", "left_anti").withColumn("n", F.length("t"))
    lengths = F.sequence(F.ceil(F.length("k") * F.lit(least)).cast("int"), F.floor(F.length("k") / F.lit(least)).cast("int"))
    near = rest.join(known.withColumn("n", F.explode(lengths)), "n").withColumn("similarity", S.similarity("t", "k")).where(F.col("similarity") >= least)
    best = near.groupBy("t").agg(F.max_by(F.struct("label", "similarity"), F.struct("similarity", "k")).alias("b")).select("t", "b.label", "b.similarity")
    return lines.withColumn("t", S.lookup_text("line")).join(exact.unionByName(best), "t").select(id_column, "pos", "line", "label", "similarity")


# ---------------------------------------------------------------------------------------------- replies
REPLY = (
    "summary map<string,string>, charges array<struct<description:string,amount:string,line:string,location:string>>, "
    "usages array<struct<line_number:string,employee_name:string,usage_type:string,description:string,usage_limit:string,usage_amount:string,charge:string>>, "
    "inventory array<struct<line_number:string,employee_name:string,plan_name:string,plan_amount:string,service_type:string>>"
)


def parse_reply(replies: DataFrame, text_column: str = "reply", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """summary, charges, usages and inventory of replies with fences or prose around them; "null" values are dropped;
    all null where there is no JSON."""
    r = F.from_json(S.json_outer(text_column), "struct<" + REPLY.replace("summary ", "summary:").replace(", charges ", ",charges:").replace(", usages ", ",usages:").replace(", inventory ", ",inventory:") + ">")
    rows = replies.select(*keep, r.alias("r")).select(*keep, "r.*")
    real = F.map_filter("summary", lambda k, v: v.isNotNull() & (F.lower(v) != "null"))
    return rows.withColumn("summary", real)


def rejected_indices(replies: DataFrame, text_column: str = "reply", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (keep, index) that a classifier's reply, an array of {index, valid}, calls invalid."""
    items = F.from_json(S.json_outer(text_column, "[]"), "array<struct<index:int,valid:boolean>>")
    rows = replies.select(*keep, F.explode(items).alias("x"))
    return rows.where("not x.valid").select(*keep, F.col("x.index").alias("index"))
