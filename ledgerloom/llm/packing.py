"""Packing by mixture-controlled deficit round-robin.

Every source is a queue of packets: its documents in the order in which they are stored, longer ones in packets of
``packet`` tokens. In every window each queue earns its quantum, its target share of the window's tokens, and sends
packets as long as what it has earned and not yet spent covers the next one; the rest, its deficit, is carried to the
next window. So a queue's packet that ends at its E-th token leaves in window ``(E - 1) // quantum``, whatever the other
queues do: the deficit after any window follows from the queue's own lengths, and every task can place its own documents
without walking the windows before. A queue that runs out leaves the rest of a window to the others.

The windows, queue after queue within each, are one stream of tokens, cut into sequences of ``length``. Passes: distinct
words and ids (``tokens``), a written table of ids with each document's place in its task's part of the queue, sums by
(window, queue) and their running total over sorted ranges, and the pass that cuts. The work of a document is bounded by
its own tokens; nothing depends on the number of sources.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import tokens as T

END_ID = 1
CELL = ["late", "window", "queue"]


class Sequences:
    """Where sequences begin in a stream of tokens: full ones, then powers of two, so that nothing is padded."""

    def __init__(self, total: int, length: int):
        self.length, self.full = length, total // length
        rest = total % length
        powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        self.tail = self.full * length + np.concatenate([[0], np.cumsum(powers)]).astype(np.int64)

    def of(self, place: np.ndarray) -> np.ndarray:
        tail = self.full + np.searchsorted(self.tail, place, side="right") - 1
        return np.where(place < self.full * self.length, place // self.length, tail)

    def start(self, sequence: np.ndarray) -> np.ndarray:
        tail = self.tail[np.clip(sequence - self.full, 0, len(self.tail) - 1)]
        return np.where(sequence <= self.full, sequence * self.length, tail)

    def cut(self, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of packets at places of the stream: (packet, first token in it, length, sequence, offset)."""
        first = self.of(place)
        many = self.of(place + size - 1) - first + 1
        sequence = T.spread(first, many)
        row = np.repeat(np.arange(len(place)), many)
        begin = np.maximum(place[row], self.start(sequence))
        end = np.minimum((place + size)[row], self.start(sequence + 1))
        return row, begin - place[row], end - begin, sequence, begin - self.start(sequence)


def _coded(docs: DataFrame, kind: str, path: str) -> DataFrame:
    """Rows (id, queue, part, place, size, ids): a document's ids, and the tokens of its queue before it in its task."""
    folder, n, stored = T.vocabulary(docs, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, places = T.Words(folder, n, stored, path), TaskContext.get().partitionId(), {}
        for batch in batches:
            for row, end, data, offsets in C.text_chunks(batch, "text"):
                ids, at = words.encode(data, offsets)
                rows = end - row
                ids = np.insert(ids, at[1:], END_ID)
                at = at + np.arange(rows + 1)
                sizes = np.diff(at)
                queues = batch.column(2).slice(row, rows)
                place = []
                for s, k in zip(queues.to_pylist(), sizes.tolist(), strict=True):
                    place.append(places.get(s, 0))
                    places[s] = place[-1] + k
                raw = ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4")
                width = raw.dtype.itemsize
                blob = pa.Array.from_buffers(
                    pa.large_binary(), rows, [None, pa.py_buffer((at * width).astype(np.int64)), pa.py_buffer(raw)]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, rows), queues, pa.array(np.full(rows, part), pa.int32()),
                        pa.array(place, pa.int64()), pa.array(sizes, pa.int64()), blob.cast(pa.binary()),
                    ],
                    names=["id", "queue", "part", "place", "size", "ids"],
                )
        C.give_back()

    return C.table(docs.mapInArrow(encode, f"id {kind}, queue string, part int, place long, size long, ids binary"), "ids", "zstd")


def quanta(sizes: DataFrame, weights: dict[str, float] | None, window_tokens: int) -> DataFrame:
    """Rows (queue, late, quantum) from rows (queue, size). Queues without a positive weight are late: they come after all
    windows of the others."""
    if weights:
        given = [("s" + k, float(w)) for k, w in weights.items() if k is not None and w > 0]
        given += [("n", float(w)) for k, w in weights.items() if k is None and w > 0]
        known = sizes.sparkSession.createDataFrame(given, "queue string, weight double")
        sizes = sizes.join(known, "queue", "left")
    else:
        sizes = sizes.withColumn("weight", F.col("size").cast("double"))
    late = F.col("weight").isNull()
    sums = sizes.groupBy(late.alias("late")).agg(F.sum(F.coalesce("weight", F.col("size").cast("double"))).alias("all"))
    share = F.coalesce("weight", F.col("size").cast("double")) / F.col("all")
    quantum = F.greatest(F.lit(1), F.round(share * window_tokens)).cast("long")
    return sizes.withColumn("late", late).join(sums, "late").select("queue", "late", quantum.alias("quantum"))


def _running(cells: DataFrame) -> DataFrame:
    """The cells with ``begin``, the tokens of all cells before in the order of CELL: sums within sorted ranges, then the
    few sums of the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            tokens = batch.column(batch.schema.get_field_index("tokens")).to_numpy()
            upto = held + np.cumsum(tokens)
            held = int(upto[-1]) if len(upto) else held
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(upto - tokens), pa.array(np.full(len(tokens), part), pa.int32())], names=[*batch.schema.names, "upto", "part"]
            )

    ranged = cells.repartitionByRange(C.shards(cells), *CELL).sortWithinPartitions(*CELL)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema)
    summed = C.table(ranged.mapInArrow(run, f"{fields}, upto long, part int"), "cells")
    totals = sorted(tuple(r) for r in summed.groupBy("part").agg(F.sum("tokens")).collect())  # one row per range
    before = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    offsets = cells.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(totals, before, strict=False)], "part int, before long")
    return summed.join(F.broadcast(offsets), "part").select(*CELL, "first", (F.col("before") + F.col("upto")).alias("begin"))


def pack(
    docs: DataFrame,
    length: int = 2048,
    weights: dict[str, float] | None = None,
    window_sequences: int = 32,
    packet: int | None = None,
    path: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, window.

    length: tokens of a sequence; the last tokens fill sequences of powers of two, so nothing is padded.
    weights: target proportions by source; by default the sources' own token shares, which hold in every window. Sources
    without a positive weight follow after all others, their window is null.
    window_sequences: sequences that a window's quanta add up to. packet: the most tokens of a document that leave
    together; by default a sequence's. In every window a source's tokens are within a packet of its quantum.

    Null and empty texts have one token, the end; long texts are whole. A null source is a source. Rows with equal ids are
    documents of their own. An empty table gives no rows. Other columns are ignored.
    """
    C.small_batches(docs.sparkSession)
    path, packet = T.tokenizer_path(path), packet or length
    kind = docs.schema[id_column].dataType.simpleString()
    docs = docs.select(
        F.col(id_column).alias("id"),
        F.col(text_column).cast("string").alias("text"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_column).cast("string")), F.lit("n")).alias("queue"),
    )
    coded = _coded(docs, kind, path)
    parts = C.table(coded.groupBy("queue", "part").agg(F.sum("size").alias("size")), "parts")
    total = parts.agg(F.sum("size")).first()[0] or 0
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rules = quanta(parts.groupBy("queue").agg(F.sum("size").alias("size")), weights, length * window_sequences)
    parts = parts.select("queue", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before")).join(rules, "queue")
    parts = C.table(parts, "places")

    def packets(*more: Column) -> DataFrame:
        """Rows (late, window, queue, start, at, count, ...): a packet's first token in its document and in its queue."""
        rows = coded.join(parts, ["queue", "part"])
        rows = rows.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(packet).cast("long"))))
        count = F.least(F.lit(packet).cast("long"), F.col("size") - F.col("start"))
        at = F.col("before") + F.col("place") + F.col("start")
        window = F.expr("(at + count - 1) div quantum").alias("window")
        return rows.select("*", count.alias("count"), at.alias("at")).select("late", window, "queue", "start", "at", "count", *more)

    cells = packets().groupBy(*CELL).agg(F.sum("count").alias("tokens"), F.min("at").alias("first"))
    sequences = Sequences(int(total), length)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, start, count, size = (batch.column(i).to_numpy() for i in range(1, 5))
            row, token, many, sequence, offset = sequences.cut(place, count)
            crc, blobs = np.empty(len(row), np.int64), batch.column(5)
            now, view = -1, memoryview(b"")
            for k, (r, a, z) in enumerate(zip(row.tolist(), (token * 4).tolist(), ((token + many) * 4).tolist(), strict=True)):
                if r != now:
                    raw = blobs[r].as_buffer()
                    now, view = r, memoryview(np.frombuffer(raw, f"<u{len(raw) // int(count[r])}").astype("<u4").view(np.uint8))
                crc[k] = zlib.crc32(view[a:z])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), *(pa.array(x, pa.int64()) for x in (start[row] + token, many, crc, size[row], sequence, offset)),
                    batch.column(6).take(at), batch.column(7).take(at),
                ],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "window"],
            )

    width = F.length("ids") / F.col("size")
    ids = F.substring("ids", (F.col("start") * width + 1).cast("int"), (F.col("count") * width).cast("int"))
    placed = packets(F.col("id"), F.col("size"), ids.alias("ids")).join(_running(cells), CELL)
    place = F.col("begin") + F.col("at") - F.col("first")
    pieces = placed.select("id", place.alias("place"), "start", "count", "size", "ids", "queue", F.when(~F.col("late"), F.col("window")).alias("window"))
    pieces = pieces.mapInArrow(
        emit,
        f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string, window long",
    )
    source = F.when(F.col("queue") != "n", F.expr("substring(queue, 2)"))
    return pieces.select(
        F.col("id").alias(id_column), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", source.alias("source"), "window"
    )
