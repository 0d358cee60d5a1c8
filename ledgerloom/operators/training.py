"""Training sets from confirmed values, line labels, candidates, models, and the gate that promotes them."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ledgerloom.functions import scalars as S
from ledgerloom.operators import feedback as FB

AROUND = 120


def variants(value: Column | str) -> Column:
    """The forms in which a value may stand in a text: as it is, without commas, with two decimals, as dates."""
    raw, number, day = S.trimmed(value), S.money(value), S.date(value)
    forms = F.array(raw, F.replace(raw, F.lit(","), F.lit("")), S.money_text(number), F.format_number(F.round(number, 2), 2))
    dated = F.when(day.isNotNull(), S.date_variants(day)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(forms, dated), lambda v: v.isNotNull() & (v != "")))


def contexts(docs: DataFrame, truth: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, label, at, context): text around the first hit of each variant of a confirmed value; of hits of a
    field less than 10 characters apart the first stays."""
    v = truth.where(~S.blank("value")).select(id_column, F.col("field").alias("label"), F.explode(variants("value")).alias("v"))
    hits = docs.select(id_column, F.col(text_column).alias("_t")).join(v, id_column).withColumn("at", F.expr("instr(_t, v)")).where("at > 0")
    near = F.array_sort(F.collect_list(F.struct("at", (-F.length("v")).alias("n"), "v")))
    # a hit stays if it lies 10 characters or more after the last one that stayed; a field has a dozen forms at most
    kept = lambda a, h: F.when((F.size(a) == 0) | (h["at"] - F.try_element_at(a, F.lit(-1))["at"] >= 10), F.concat(a, F.array(h))).otherwise(a)
    few = hits.groupBy(id_column, "label").agg(near.alias("h"))
    few = few.select(id_column, "label", F.explode(F.aggregate("h", F.filter("h", lambda x: F.lit(False)), kept)).alias("x")).select(id_column, "label", "x.at", "x.v")
    hits = few.join(docs.select(id_column, F.col(text_column).alias("_t")), id_column)
    return hits.select(id_column, "label", F.col("at").cast("int").alias("at"), S.context("_t", F.col("at"), F.length("v"), AROUND).alias("context"))


def negatives(docs: DataFrame, positives: DataFrame, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, label "none", at, context): twice as many lines as positives, 10 at least, of 5 to 199 characters and
    farther than AROUND from any positive, by the hash of document, place and seed."""
    lines = docs.select(id_column, F.posexplode(F.split(text_column, "\n")).alias("pos", "s"))
    before = Window.partitionBy(id_column).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("at", (F.coalesce(F.sum(F.length("s") + 1).over(before), F.lit(0)) + 1).cast("int"))
    lines = lines.select(id_column, "pos", F.trim("s").alias("context"), "at").where(F.length("context").between(5, 199))
    near = positives.groupBy(id_column).agg(F.collect_list("at").alias("places"), F.count("*").alias("n"))
    lines = lines.join(near, id_column).where(~F.exists("places", lambda p: F.abs(p - F.col("at")) <= AROUND))
    order = F.row_number().over(Window.partitionBy(id_column).orderBy(F.xxhash64(id_column, "pos", F.lit(seed))))
    return lines.withColumn("_n", order).where(F.col("_n") <= F.greatest(F.col("n") * 2, F.lit(10))).select(id_column, F.lit("none").alias("label"), "at", "context")


def line_labels(lines: DataFrame, summary: DataFrame, charges: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Lines (id, pos, line) labelled Summary, Charges or Ignore by whether they hold a confirmed value or charge."""
    s = summary.where(F.length("value") >= 3).groupBy(id_column).agg(F.collect_set("value").alias("_s"))
    c = charges.where(F.length("charge_desc") >= 3).groupBy(id_column).agg(F.collect_set(F.lower("charge_desc")).alias("_c"))
    rows = lines.join(s, id_column, "left").join(c, id_column, "left")
    has = lambda values, text: F.coalesce(F.exists(values, lambda v: F.contains(text, v)), F.lit(False))
    label = F.when(has("_s", F.col("line")), "Summary").when(has("_c", F.lower("line")), "Charges").otherwise("Ignore")
    return rows.select(id_column, "pos", "line", label.alias("label"))


def label_distribution(samples: DataFrame) -> DataFrame:
    return samples.groupBy(F.lower("label").alias("label")).agg(F.count("*").alias("n"))


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, kind, value, context): dates, long dates, amounts, numbers of 5 digits, hyphenated numbers, each once."""
    kinds = {
        "date": r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b", "long_date": r"\b([A-Z][a-z]+ \d{1,2}, \d{4})\b", "amount": r"(-?[\d,]*\d\.\d{2})\b",
        "number": r"\b(\d{5,})\b", "hyphenated": r"\b(\d{3,}(?:-\d+)+)\b",
    }
    found = [F.regexp_extract_all(F.col(text_column), F.lit(p), F.lit(1)) for p in kinds.values()]
    parts = [docs.select(id_column, F.col(text_column).alias("_t"), F.lit(k).alias("kind"), F.explode(F.array_distinct(f)).alias("value")) for k, f in zip(kinds, found, strict=True)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.select(id_column, "kind", "value", S.context("_t", F.expr("instr(_t, value)"), F.length("value"), AROUND).alias("context"))


def best_per_label(predictions: DataFrame, least: float = 0.3, id_column: str = "doc_id") -> DataFrame:
    """The best scored candidate of each label but none, of score ``least`` or more; the first on ties."""
    order = F.row_number().over(Window.partitionBy(id_column, "label").orderBy(F.desc("score"), "pos"))
    return predictions.where((F.col("score") >= least) & (F.col("label") != "none")).withColumn("_n", order).where("_n = 1").drop("_n")


def text_model(samples: DataFrame, text_column: str = "context", label_column: str = "label", least: int = 20, seed: int = 42):
    """A fitted multinomial classifier of texts and its accuracy on a fifth held out; None with too few samples."""
    if samples.limit(least).count() < least:
        return None
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import HashingTF, RegexTokenizer, StringIndexer

    stages = [
        StringIndexer(inputCol=label_column, outputCol="y", handleInvalid="skip"),
        RegexTokenizer(inputCol=text_column, outputCol="words", pattern=r"[^\w]+"),
        HashingTF(inputCol="words", outputCol="x", numFeatures=1 << 14),
        LogisticRegression(featuresCol="x", labelCol="y", maxIter=100, regParam=1e-3),
    ]
    train, test = samples.randomSplit([0.8, 0.2], seed)
    model = Pipeline(stages=stages).fit(train)
    score = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy").evaluate(model.transform(test))
    return model, score


def due_for_training(total: int, trained: int, least: int = 5, fresh: int = 5) -> bool:
    return total >= least and total - trained >= fresh


def promotion(metrics: DataFrame, gain: float = 0.005, tolerance: float = 0.02) -> DataFrame:
    """Rows (version, old_score, new_score) with decision and reason: a regression beyond the tolerance, or too small a
    gain over a real old score, keeps the old model."""
    delta = F.col("new_score") - F.coalesce("old_score", F.lit(0.0))
    reason = F.when(delta < -tolerance, "regression").when((F.coalesce("old_score", F.lit(0.0)) > 0) & (delta < gain), "gain too small").otherwise("better")
    return metrics.select("*", reason.alias("reason"), (reason == "better").alias("promoted"))


#: The four labels of words and the keys under which corrections may give them, in order (fixed values).
WEAK = {
    "INVOICE_NO": ("invoice_no", "invoice_number"),
    "DATE": ("date", "invoice_date", "invoice_st_dtm", "invoice_end_dtm", "invoice_due_dtm"),
    "TOTAL": ("total", "end_bal", "curr_chg", "beg_bal", "payment", "curr_tax", "prev_adj", "curr_adj", "carrier_account", "account"),
    "VENDOR": ("vendor", "carrier_name"),
}


def weak_targets(fields: Column | str) -> Column:
    """A map from word label to the corrected value that stands for it."""
    pairs = [F.struct(F.lit(label).alias("k"), S.map_get(S.col(fields), *keys).alias("v")) for label, keys in WEAK.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))


def weak_labels(pages: DataFrame, most: int = 40) -> DataFrame:
    """Pages (doc_id, page, words, corrected_fields) with ``labels``, one for each word: for every label the span of at most
    ``most`` words that holds the value, or lies within it, and is longest against it; later labels overwrite."""

    @F.pandas_udf(ArrayType(StringType()))
    def label(words: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([span_labels(list(w), dict(t), most) for w, t in zip(words, wanted, strict=True)])

    return pages.withColumn("labels", label("words", weak_targets("corrected_fields")))


def span_labels(words: list[str], wanted: dict[str, str], most: int = 40) -> list[str]:
    """Word labels of one page; O where none fits."""
    plain = [" ".join((w or "").lower().split()) for w in words]
    out = ["O"] * len(words)
    for name in WEAK:
        target = " ".join(wanted.get(name, "").lower().split())
        best, place = -1, None
        for i in range(len(words) if target else 0):
            text = ""
            for j in range(i, min(i + most, len(words))):
                text = f"{text} {plain[j]}".strip()
                if text and (target in text or text in target) and len(text) > best:
                    best, place = len(text), (i, j)
                if len(text) > 3 * len(target):
                    break
        if place:
            out[place[0] : place[1] + 1] = [name] * (place[1] + 1 - place[0])
    return out


class TokenTrainer(Protocol):
    """The port of an outside trainer of word labels: pages (words, bboxes, labels) for training and for evaluation, and
    the folder for the model; gives its score. ``token_dataset`` makes its input; none runs unless it is given."""

    def __call__(self, train: DataFrame, evaluate: DataFrame, folder: str) -> float: ...


def token_dataset(pages: DataFrame, share: float = 0.15, least: int = 5, key: str = "doc_id") -> tuple[DataFrame, DataFrame] | None:
    """Labelled pages, words and labels of equal number, split by the hash of their key; None with fewer than ``least``."""
    good = pages.where((F.size("words") > 0) & (F.size("words") == F.size("labels")))
    if good.limit(least).count() < least:
        return None
    held = F.pmod(F.xxhash64(F.col(key)), F.lit(1000)) < int(share * 1000)
    return good.where(~held), good.where(held)


def predict_lines(lines: DataFrame, labelled: DataFrame, model: Callable[[DataFrame], DataFrame], id_column: str = "doc_id") -> DataFrame:
    """Rows (id, pos, line, label, confidence, source): the label of the nearest labelled line, else the model's.

    model: gives rows (id, pos, label, confidence) for lines (id, pos, line)."""
    near = FB.fuzzy_lookup(lines, labelled, id_column=id_column).select(id_column, "pos", "line", "label", F.col("similarity").alias("confidence"), F.lit("feedback").alias("source"))
    rest = lines.join(near.select(id_column, "pos"), [id_column, "pos"], "left_anti")
    guessed = rest.join(model(rest).select(id_column, "pos", "label", "confidence"), [id_column, "pos"], "left")
    return near.unionByName(guessed.select(id_column, "pos", "line", "label", "confidence", F.lit("model").alias("source")))


class Retrainer:
    """One training at a time: a call during another is refused; a finished one replaces the model that ``model`` reads."""

    def __init__(self, train: Callable[[], object]):
        self._train, self._lock, self._model = train, threading.Lock(), None

    @property
    def model(self) -> object:
        return self._model

    def retrain(self) -> bool:
        if not self._lock.acquire(blocking=False):
            return False
        try:
            self._model = self._train()
            return True
        finally:
            self._lock.release()


def active_version(configured: str | None, active: str | None, versions: DataFrame) -> str | None:
    """The configured model, else the active one, else the newest by name."""
    return configured or active or versions.agg(F.max("version")).first()[0]
