"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits, each the majority over the XXH64 hashes of a text's word shingles. Distinct fingerprints are
then linked at a Hamming distance of ``distance`` or less:

1. Bits are grouped into partitions, correlated bits together, from the 64 x 64 table of joint counts.
2. A dynamic program gives each partition a threshold of its own (-1: unused) such that the thresholds plus one sum
   to distance + 1, at the least estimated cost of candidates and signatures; the number of partitions is chosen too.
   A pair within the distance then agrees within its threshold on at least one partition.
3. A partition with threshold t yields one signature for every choice of t of its bits to leave out. Fingerprints meet
   by signature. Within a signature each task links what is truly within the distance and emits only a spanning
   forest, never all pairs. Signatures with more than ``block`` fingerprints are dealt out as pairs of blocks.
4. Distributed connected components join the forests.

Nothing is capped: blocks of a large signature meet pairwise, whatever its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import spread

SEED = 42


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[list[bytes], np.ndarray]:
    """All shingles of a chunk's texts, A-Z in lower case, and where each text's begin; a short text has one, an empty
    text none."""
    docs = len(offsets) - 1
    s, e, doc = C.words(data, offsets)
    if not len(s):
        return [], np.zeros(docs + 1, np.int64)
    length = e - s + 1
    flat = np.append(C.LOWER[data], np.uint8(0x20))[spread(s, length)]
    end = np.cumsum(length) - 1
    flat[end] = 0x20
    start = end - length + 1
    per_doc = np.bincount(doc, minlength=docs)
    first = np.cumsum(per_doc) - per_doc
    count = np.where(per_doc > 0, np.maximum(per_doc - size + 1, 1), 0)
    begin = spread(first, count)
    last = np.minimum(begin + size, (first + per_doc)[np.repeat(np.arange(docs), count)]) - 1
    raw = flat.tobytes()
    found = [raw[a:b] for a, b in zip(start[begin].tolist(), end[last].tolist(), strict=True)]
    return found, np.concatenate([[0], np.cumsum(count)])


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    found, at = shingles(data, offsets, size)
    out = np.zeros(len(offsets) - 1, C.U)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        h = np.fromiter((xxh64_intdigest(x, SEED) for x in found), C.U, len(found))
        votes = np.empty((len(full), 64), np.int64)
        edges = np.append(at[full], at[-1])
        step = 0
        while step < len(full):  # a few hundred thousand shingles at a time
            stop = max(step + 1, int(np.searchsorted(edges, edges[step] + 300_000, side="right")) - 1)
            part = h[edges[step] : edges[stop]].astype(">u8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(part, axis=1)
            votes[step:stop] = np.add.reduceat(bits, edges[step:stop] - edges[step], axis=0, dtype=np.int32)
            step = stop
        majority = votes * 2 > np.diff(edges)[:, None]
        out[full] = np.packbits(majority, axis=1).view(">u8").reshape(-1).astype(C.U)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, fp): the 64-bit fingerprint of every whole text as a long; null and empty texts have zero."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in C.text_chunks(batch):
                fp = fingerprints_of(data, offsets, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(fp)], names=["id", "fp"])
        C.give_back()

    C.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_column)


# ---------------------------------------------------------------------------------------------- plan
def joint_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits how many have both; summed in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((64, 64)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="big").astype(np.float32)
            total += bits.T @ bits
            rows += len(bits)
        counts = np.append(total.reshape(-1), rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097), pa.int32()), pa.array(counts)], names=["k", "c"])

    sums = {r["k"]: r["c"] for r in fps.select("fp").mapInArrow(run, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()}
    return int(sums.get(4096, 0)), np.array([sums.get(k, 0) for k in range(4096)], float).reshape(64, 64)


def group_bits(n: int, joint: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of the 64 bits of nearly equal size, correlated bits together (bit 0 is the highest)."""
    p = np.diag(joint) / max(n, 1)
    cov = joint / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(64)), []
    for k in range(parts):
        size = (64 * (k + 1)) // parts - (64 * k) // parts
        left = sorted(free)
        group = [left[int(np.argmax(corr[np.ix_(left, left)].sum(axis=1)))]]
        while len(group) < size:
            left = sorted(free - set(group))
            group.append(left[int(np.argmax(corr[np.ix_(left, group)].sum(axis=1)))])
        free -= set(group)
        groups.append(sorted(group))
    return groups


def allocate(n: int, joint: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """Least estimated cost and the partitions' thresholds, by dynamic programming over partitions and budget."""
    p = np.diag(joint) / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-6, 1)
    costs = []
    for g in groups:
        at = np.zeros(distance + 1)  # chance that a random pair differs in exactly k of the partition's bits
        at[0] = 1
        for b in g:
            at[1:] = at[1:] * (1 - differ[b]) + at[:-1] * differ[b]
            at[0] *= 1 - differ[b]
        cost = [0.0]
        for t in range(distance + 1):
            signatures = math.comb(len(g), t)
            # a pair that differs in d of the bits meets in comb(size - d, t - d) of the signatures
            meets = sum(at[d] * math.comb(len(g) - d, t - d) for d in range(t + 1))
            cost.append(n * n / 2 * meets * 2e-3 + n * signatures if t < len(g) else math.inf)
        costs.append(cost)
    budget = distance + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for k in range(budget - used + 1):  # k = threshold + 1
                x = (c + cost[k], [*ts, k - 1])
                if used + k not in after or x[0] < after[used + k][0]:
                    after[used + k] = x
        best = after
    return best.get(budget, (math.inf, []))


def masks(fps: DataFrame, distance: int) -> list[int]:
    """Bit masks of all signatures under the best plan."""
    n, joint = joint_counts(fps)
    plans = []
    for parts in range(1, min(2 * distance + 2, 16) + 1):
        groups = group_bits(n, joint, parts)
        plans.append((*allocate(n, joint, groups, distance), groups))
    _, thresholds, groups = min(plans, key=lambda x: x[0])
    out = []
    for g, t in zip(groups, thresholds, strict=True):
        if t >= 0:
            out += [sum(1 << (63 - b) for b in g if b not in gone) for gone in combinations(g, t)]
    return out


# ---------------------------------------------------------------------------------------------- probe and verify
def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def forest(fp: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint of a set the index of a root; those joined within the set by links share it.

    Breadth first: each fingerprint is compared only with those not reached yet, so a dense set costs little.
    """
    root, left = np.full(len(fp), -1), np.arange(len(fp))
    while len(left):
        start, left = left[0], left[1:]
        root[start] = start
        front = np.array([start])
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            step = max(1, 2_000_000 // len(left))
            for i in range(0, len(front), step):
                todo = np.flatnonzero(~hit)
                if not len(todo):
                    break
                near = _near(fp[front[i : i + step], None], fp[left[todo]][None, :], distance)
                hit[todo[near.any(axis=0)]] = True
            front, left = left[hit], left[~hit]
            root[front] = start
    return root


def small_forests(group: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """The same for many small sets at once; rows are sorted by group."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    here, d = np.arange(len(fp)), 1
    while True:
        here = here[here + d < len(fp)]
        here = here[group[here] == group[here + d]]
        if not len(here):
            break
        hit = here[_near(fp[here], fp[here + d], distance)]
        a.append(hit)
        b.append(hit + d)
        d += 1
    return C.local_forest(len(fp), np.concatenate(a), np.concatenate(b))


def links(fps: DataFrame, distance: int = 3, block: int = 8192) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp, long) that span every linked component."""
    signature_masks = masks(fps, distance)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(C.U)
            for i, m in enumerate(signature_masks):
                key = C.mix((fp & C.U(m)) + C.mix(np.array([i + 1], C.U)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["key", "fp"])

    keys = fps.select("fp").mapInArrow(sign, "key long, fp long")
    large = keys.groupBy("key").count().where(F.col("count") > block).withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    large = C.table(large.select("key", "blocks"), "large-signatures")
    if large.limit(1).count():
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = (
            keys.join(large, "key", "left")
            .select("key", "fp", F.coalesce("blocks", F.lit(1)).alias("blocks"))
            .withColumn("mine", mine)
            .withColumn("other", other)
            .select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp")
        )
    else:
        dealt = keys

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            root = np.arange(len(key))
            few = np.repeat((size > 1) & (size <= 64), size)
            at = np.flatnonzero(few)
            root[at] = at[small_forests(key[at], fp[at], distance)]
            for i in np.flatnonzero(size > 64):
                part = slice(first[i], first[i] + size[i])
                root[part] = first[i] + forest(fp[part], distance)
            far = np.flatnonzero(root != np.arange(len(key)))
            pairs = np.unique(np.stack([fp[far], fp[root[far]]], axis=1), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        keys, fps = np.empty(0, np.int64), np.empty(0, C.U)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(C.U)])
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last signature may go on
            if last:
                yield solve(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
        if len(keys):
            yield solve(keys, fps)

    met = dealt.repartition(C.shards(fps), "key").sortWithinPartitions("key")
    return met.mapInArrow(verify, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = 3, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: id, fp (long), component_id (smallest id reachable by links, itself included).

    Null and empty texts have fingerprint zero and link like any other. Rows with equal ids and texts are linked; a
    null id is never the smallest unless a component has no other. Other columns are ignored.
    """
    signed = C.table(fingerprints(docs, shingle, id_column, text_column), "fingerprints")
    reps = C.table(signed.groupBy("fp").agg(F.min(id_column).alias("rep")), "distinct-fingerprints")
    joined = C.components(C.table(links(reps, distance), "fingerprint-links"))
    rooted = reps.join(joined.select(F.col("id").alias("fp"), "root"), "fp", "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root")
    )
    lows = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = rooted.join(lows, "root").select("fp", "component_id")
    return signed.join(classes, "fp").select(id_column, "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3, id_column: str = "doc_id") -> DataFrame:
    """Documents of which one stays per component: that with the smallest id; see ``keep_smallest``."""
    return keep_smallest(docs, near_duplicates(docs, shingle, distance, id_column), id_column)


def keep_smallest(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents whose id is the smallest of its component, from rows (id, component_id), with all their columns.

    Of rows with equal ids and texts one stays; rows with equal ids and other texts stay if one of them does. Rows with a
    null id all stay. An empty table gives no rows.
    """
    found = C.table(found, "near-duplicates")
    keep = found.where(F.col(id_column) == F.col("component_id")).select(id_column)
    kept = docs.join(keep.distinct(), id_column, "left_semi")
    if keep.groupBy(id_column).count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([id_column, text_column])
    return kept.unionByName(docs.where(F.col(id_column).isNull())).select(docs.columns)


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Rows (id, fingerprint, component_id), one for each row of ``near_duplicates``: 16 lowercase hexadecimal digits, for
    texts without words all zero."""
    return found.select(id_column, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
