"""Word boxes to lines and sections, normalised boxes, label runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S

HULL = [F.min, F.min, F.max, F.max]


def kept_words(words: DataFrame, least: float = 0) -> DataFrame:
    """Words that are not blank and whose confidence is unknown (negative) or at least ``least``."""
    return words.where(~S.blank("text") & ((F.col("conf") < 0) | (F.col("conf") >= least)))


def lines_by_gap(words: DataFrame, gap: float = 5.0, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Words (keys, word, x, y, text) to lines: a new one where y differs by more than ``gap`` from the word before."""
    order = Window.partitionBy(*keys).orderBy("word")
    far = F.abs(F.col("y") - F.lag("y").over(order)) > gap
    rows = words.withColumn("line_no", F.sum(F.coalesce(far, F.lit(False)).cast("int")).over(order).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word", "text"))), lambda w: w["text"]), " ")
    return rows.groupBy(*keys, "line_no").agg(text.alias("line"))


def _hull():
    return [
        F.min("x").alias("x0"),
        F.min("y").alias("y0"),
        F.max(F.col("x") + F.col("w")).alias("x1"),
        F.max(F.col("y") + F.col("h")).alias("y1"),
    ]


def lines_by_block(words: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Words with block and line numbers to lines: text in order of x, hull box."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word", "text"))), lambda w: w["text"]), " ")
    return words.groupBy(*keys, "block", "line").agg(text.alias("text"), F.count("*").alias("n_words"), *_hull())


def sections(lines: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Lines to sections by block: text with line feeds, hull box."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    hull = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return lines.groupBy(*keys, "block").agg(text.alias("text"), F.count("*").alias("n_lines"), *hull)


def normalised_boxes(boxes: DataFrame) -> DataFrame:
    """x0 y0 x1 y1 on the 0 to 1000 scale of the page (width_px, height_px), clamped."""
    size = {"x": F.col("width_px"), "y": F.col("height_px")}
    return boxes.withColumns({c: S.scaled(F.col(c), size[c[0]]) for c in ("x0", "y0", "x1", "y1")})


def page_text(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Lines to one text, pages apart by a blank line."""
    pages = lines.groupBy(*keys, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "text"))), lambda x: x["text"]), "\n").alias("t"))
    return pages.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\n\n").alias("text"))


def best_pieces(pieces: DataFrame, keys: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """The most confident piece of each word."""
    return pieces.groupBy(*keys).agg(F.max_by("label", "confidence").alias("label"), F.max("confidence").alias("confidence"))


def label_runs(words: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Runs of equal labels other than O: (id, label, start, text, n_words, confidence), confidence the mean."""
    by, same = Window.partitionBy(id_column).orderBy("pos"), Window.partitionBy(id_column, "label").orderBy("pos")
    rows = words.withColumn("island", F.row_number().over(by) - F.row_number().over(same)).where("label <> 'O'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ")
    return rows.groupBy(id_column, "label", "island").agg(
        F.min("pos").alias("start"), text.alias("text"), F.count("*").alias("n_words"), F.round(F.avg("confidence"), 4).alias("confidence")
    ).drop("island")


def fields_from_runs(runs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The longest run's text of each label, the first on ties."""
    best = F.row_number().over(Window.partitionBy(id_column, "label").orderBy(F.desc(F.length("text")), "start"))
    return runs.withColumn("_n", best).where("_n = 1").drop("_n")


def token_accuracy(tokens: DataFrame, ignored: int = -100) -> DataFrame:
    """Share of tokens whose predicted label is the true one, ignored labels left out."""
    return tokens.where(F.col("label") != ignored).agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
