"""Structured Streaming: parsing of arriving bills, duplicate guard, retraining triggers, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions import scalars as S
from ledgerloom.operators import summary as M
from ledgerloom.sources import tables


def parse_stream(docs: DataFrame) -> DataFrame:
    """Typed summaries of a stream of documents; the same narrow plan as in batch."""
    return M.typed(M.summary_text(docs))


def new_bills(bills: DataFrame, saved: DataFrame, delay: str = "1 day", time_column: str = "ts") -> DataFrame:
    """Bills of a stream that are new: each number and carrier once within the delay, and not saved before."""
    fresh = bills.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["invoice_number", "carrier_id"])
    return fresh.join(saved.select("invoice_number", "carrier_id").distinct(), ["invoice_number", "carrier_id"], "left_anti")


def on_new_rows(stream: DataFrame, act: Callable[[int], None], least: int, checkpoint: str, every: str = "5 seconds") -> StreamingQuery:
    """Call ``act`` with the rows so far whenever ``least`` more have come; the count survives restarts, as it is kept
    with the checkpoint."""
    spark, path = stream.sparkSession, f"{checkpoint}/counts"

    def step(batch: DataFrame, number: int) -> None:
        batch.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        counts = spark.read.schema("n long, batch int").parquet(path)
        total, last = counts.agg(F.sum("n"), F.sum(F.when(F.col("batch") == number, F.col("n")))).first()
        if total // least > (total - last) // least:
            act(total)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(step).start()


def event_windows(events: DataFrame, kind: str = "tumbling", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling hours, hours sliding by half, or sessions with gaps of half an hour."""
    ts = F.col("ts").cast("timestamp")
    rows = events.withColumn("ts", ts)
    if events.isStreaming:
        rows = rows.withWatermark("ts", delay)
    window = {"tumbling": F.window("ts", "1 hour"), "sliding": F.window("ts", "1 hour", "30 minutes"), "session": F.session_window("ts", "30 minutes")}[kind]
    key = [window.alias("w"), "event_type"] + (["user_id"] if kind == "session" else [])
    out = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(28,4)").alias("total"))
    keep = ["event_type", *(["user_id"] if kind == "session" else [])]
    return out.select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), *keep, "n", "total")


def labelled_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled lines from CSV files as they arrive in a folder: rows (text, label) as in ``tables.labelled_rows``."""
    raw = spark.readStream.schema("value string").option("pathGlobFilter", "*.csv").text(folder)
    return tables.labelled_rows(raw)


def append_stream(feedback: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of feedback to a log of JSON files, exactly once, until what has come is written."""
    return feedback.writeStream.format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def lookup_stream(lines: DataFrame, labelled: DataFrame) -> DataFrame:
    """Lines of a stream (doc_id, pos, line) with the label of the newest equal labelled line (text, label, created_at),
    null without one. The labelled side is read anew with every batch, so corrections count from the next batch on."""
    known = labelled.select(S.lookup_text("text").alias("_k"), "label", "created_at").where("_k <> ''")
    known = known.groupBy("_k").agg(F.max_by("label", "created_at").alias("label"))
    return lines.withColumn("_k", S.lookup_text("line")).join(known, "_k", "left").drop("_k")
