"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors of a label are one node with a multiplicity. Every node gets one code per table, the signs of its
products with random hyperplanes; nodes of a label that share a table's code meet. Each meeting computes exact
cosines in double precision, adds up how many vectors each node links to and emits a spanning forest only. A pair
that shares codes in several tables is counted in the first of them alone, for which rows carry all codes. Codes with
more than ``block`` nodes are dealt out as pairs of blocks; nothing is capped.

The code length follows the mean label size, so that a code holds a few hundred nodes; the number of tables follows
from it such that a pair at the threshold is missed with a chance of ``miss`` at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SUB = 1024


def width_of(rows: DataFrame, vector_column: str) -> str:
    """The numpy type in which a column's components are kept: that of the column, so nothing is rounded."""
    return "<f4" if rows.schema[vector_column].dataType.simpleString() == "array<float>" else "<f8"


def vectors(rows: DataFrame, vector_column: str, keep: list[str]) -> DataFrame:
    """The kept columns and ``vec``: the components' bytes; null for what takes no part (null, empty,
    zero, or with a null or non-finite component)."""
    width = width_of(rows, vector_column)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(batch.num_columns - 1):
                x = None
                if v.is_valid and len(v.values) and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                    elif not 1e-200 < np.abs(x).max() < 1e150:  # a power of two keeps the angle; squares stay in range
                        x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))
                out.append(None if x is None else (x + 0.0).astype(width).tobytes())  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(out, pa.binary())],
                names=[*batch.schema.names[:-1], "vec"],
            )

    return rows.select(*keep, vector_column).mapInArrow(run, f"{fields}, vec binary")


def tables_for(nodes: int, labels: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a code and number of tables."""
    bits = min(max(4, math.ceil(math.log2(max(nodes / max(labels, 1) / 256, 2)))), 30)
    agree = (1 - math.acos(min(max(threshold, -1), 1)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-min(agree, 1 - 1e-9))))


def _solve(ids, mult, x, codes, block, table, threshold):
    """Links of the nodes of one meeting: (counts by node, root index by node)."""
    n = len(ids)
    counts, root = np.zeros(n, np.int64), np.arange(n)
    norm = x / np.sqrt((x * x).sum(axis=1))[:, None]
    two = block[0] != block[-1]  # sorted by block: in a meeting of two blocks only pairs across count
    for a in range(0, n, SUB):
        for b in range(a, n, SUB):
            if two and block[min(a + SUB, n) - 1] == block[a] == block[min(b + SUB, n) - 1]:
                continue
            if two and block[a] == block[b] == block[min(b + SUB, n) - 1]:
                continue
            i, j = np.nonzero(norm[a : a + SUB] @ norm[b : b + SUB].T >= threshold)
            i, j = i + a, j + b
            keep = i < j
            if two:
                keep &= block[i] != block[j]
            i, j = i[keep], j[keep]
            if table:
                new = ~(codes[i, :table] == codes[j, :table]).any(axis=1)
                i, j = i[new], j[new]
            np.add.at(counts, i, mult[j])
            np.add.at(counts, j, mult[i])
            p, q = root[i], root[j]
            far = p != q
            if far.any():
                root = C.local_forest(n, p[far], q[far])[root]
    return counts, root


def near_duplicates(
    rows: DataFrame,
    threshold: float = 0.98,
    miss: float = 1e-6,
    block: int = 8192,
    seed: int = 42,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id (smallest id reachable), kept.

    Vectors link only within an equal, non-null label. What takes no part (see ``vectors``; a null label or id; other
    dimensions) links with nothing and is its own component. Rows with equal ids share their links. Other columns are
    ignored.
    """
    spark, width = rows.sparkSession, width_of(rows, vector_column)
    given = C.table(vectors(rows, vector_column, [id_column, label_column]).toDF("id", "label", "vec"), "vectors")
    valid = given.where("id is not null and label is not null and vec is not null")
    nodes = C.table(valid.groupBy("label", "vec").agg(F.min("id").cast("long").alias("node"), F.count("*").alias("mult")), "nodes")
    n, labels = nodes.agg(F.count("*"), F.approx_count_distinct("label")).first()
    bits, tables = tables_for(n, labels, threshold, miss)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for batch in batches:
            raw = batch.column(1).to_pylist()
            sizes = np.array([len(r) for r in raw], np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(raw[i] for i in at), width).astype(np.float64).reshape(len(at), -1)
                if size not in planes:
                    planes[size] = np.random.default_rng(seed).standard_normal((x.shape[1], tables * bits))
                codes = ((x @ planes[size] > 0).reshape(len(at), tables, bits) * weights).sum(axis=2).astype(np.uint32)
                part = batch.take(pa.array(at))
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0), pa.array(np.full(len(at), size), pa.int32()), pa.array(np.full(len(at), t), pa.int32()),
                            pa.array(codes[:, t].astype(np.int64)), part.column(2), part.column(3), packed, part.column(1),
                        ],
                        names=["label", "size", "tab", "code", "node", "mult", "codes", "vec"],
                    )

    label_type = nodes.schema["label"].dataType.simpleString()
    signed = nodes.select("label", "vec", "node", "mult").mapInArrow(
        sign, f"label {label_type}, size int, tab int, code long, node long, mult long, codes binary, vec binary"
    )
    key = ["label", "size", "tab", "code"]
    large = signed.select(*key).groupBy(*key).count().where(F.col("count") > block)
    large = C.table(large.select(*key, F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large-codes")
    if large.limit(1).count():
        dealt = (
            signed.join(large, key, "left")
            .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("low", F.least("block", "other"))
            .withColumn("high", F.greatest("block", "other"))
        )
    else:
        dealt = signed.select("*", *(F.lit(0).alias(c) for c in ("block", "low", "high")))
    dealt = dealt.select(
        F.xxhash64(*key, "low", "high").alias("key"), "block", "tab", "node", "mult", "codes", "vec"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> pa.RecordBatch:
            k = t.column("key").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            edges = np.append(first, len(k))
            block, tab, node, mult = (t.column(c).to_numpy() for c in ("block", "tab", "node", "mult"))
            raw, codes = t.column("vec").to_pylist(), t.column("codes").to_pylist()
            out: list[np.ndarray] = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a < 2 or len({len(r) for r in raw[a:b]}) > 1:
                    continue
                x = np.frombuffer(b"".join(raw[a:b]), width).astype(np.float64).reshape(b - a, -1)
                c = np.frombuffer(b"".join(codes[a:b]), np.uint32).reshape(b - a, -1)
                counts, root = _solve(node[a:b], mult[a:b], x, c, block[a:b], int(tab[a]), threshold)
                some = np.flatnonzero(counts)
                far = np.flatnonzero(root != np.arange(b - a))
                out.append(np.stack([node[a:b][some], node[a:b][some], counts[some]], axis=1))
                out.append(np.stack([node[a:b][far], node[a:b][root[far]], np.zeros(len(far), np.int64)], axis=1))
            rows = np.concatenate([np.empty((0, 3), np.int64), *out])
            return pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], names=["a", "b", "n"])

        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            k = held.column("key").to_numpy()
            last = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last meeting may go on
            if last:
                yield solve(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield solve(held)

    met = dealt.repartition(C.shards(rows), "key").sortWithinPartitions("key", "block")
    found = C.table(met.mapInArrow(verify, "a long, b long, n long"), "vector-links")
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = C.components(found.where("a <> b").select("a", "b"), "vector-components")
    known = (
        nodes.select("label", "vec", "node", "mult")
        .join(counts, "node", "left")
        .join(roots.select(F.col("id").alias("node"), "root"), "node", "left")
        .select(
            "label", "vec",
            (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("root", "node").alias("component_id"),
        )
    )
    linked = valid.join(known, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = given.where("id is null or label is null or vec is null").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id")
    )
    return linked.unionByName(alone).select(
        F.col("id").alias(id_column),
        "n_links",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


#: The same rows in SQL for the defaults.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach AS (SELECT vec_id AS id, vec_id AS node FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.node = links.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, r.low AS component_id, e.vec_id = r.low AS kept
FROM embeddings e JOIN (SELECT id, min(node) AS low FROM reach GROUP BY id) r ON r.id = e.vec_id
"""
