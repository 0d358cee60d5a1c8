"""Span columns that the privacy and secret operators share: spans, counts, digest and the joined string."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int]


def joined(spans: Sequence[Span], order: dict[str, int]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def scan(
    docs: DataFrame, find: Callable[[], Callable[[str], tuple[list[Span], list[Span]]]], id_column: str, text_column: str
) -> DataFrame:
    """Rows (id, base, more): arrays of structs kind, start, end, in code points.

    ``find()`` is called once per task and gives the function that scans one text. One narrow pass; no exchange. Null
    texts are empty; long texts are scanned whole; repeated rows and equal or null ids each have a row; an empty table
    has none; other columns are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    span = "array<struct<kind:string,start:int,stop:int>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = find()
        for batch in batches:
            found = [one(t) for t in pc.fill_null(batch.column(1), "").to_pylist()]
            arrays = [
                pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in f[i]] for f in found], type=arrow)
                for i in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", "base", "more"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, base {span}, more {span}").withColumnRenamed("id", id_column)


def digest(found: DataFrame, id_column: str, base_kinds: Sequence[str], all_kinds: Sequence[str]) -> DataFrame:
    """Counts by base kind, the SHA-256 of the base spans and the string of all spans, one row for each row of ``scan``; a
    null, empty or clean text has counts of zero, the digest of the empty string and an empty string."""
    order = F.create_map(*[x for i, k in enumerate(all_kinds) for x in (F.lit(k), F.lit(i))])

    def text(column):
        keyed = F.transform(
            column,
            lambda s: F.struct(s["start"].alias("a"), order[s["kind"]].alias("o"), s["stop"].alias("b"), s["kind"].alias("k")),
        )
        return F.array_join(
            F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["k"], s["a"], s["b"])), ","
        )

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base_kinds]
    spans = text(F.concat("base", "more")).alias("spans")
    return found.select(id_column, *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
