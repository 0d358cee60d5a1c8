"""Exact top-k by inner product: KD-trees per shard, best-first traversal, a kth score that is carried between shards.

Median splits of a bounded sample cut the space into cells; a cell that holds more than ``shard_rows`` vectors (a hot
one, or one of very many vectors) is dealt by hash into several shards. Every shard has a tight bounding box and a
KD-tree (median splits of the widest side, a box and the smallest id per node). The largest inner product of a query
with any point of a box bounds what the box can hold, so boxes are opened in order of their bounds until the next bound
is below the query's kth score. Three waves pass that score on: the query's own shard, then the few shards with the best
bounds, then every other shard whose bound still reaches the kth score. Scores are exact integers; ties go to the
smaller id. The sample decides only where vectors lie, never which are found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LEAF = 64
NONE = -(1 << 62)


class Tree:
    """A KD-tree over integer vectors; nodes are numbered, with boxes as matrices."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.whole = ids[order], x[order]
        self.x = self.whole.astype(np.float64)
        low, high, least, self.leaf, self.children = [], [], [], {}, {}
        todo = [(np.arange(len(ids)), -1)]
        while todo:
            rows, parent = todo.pop()
            node, part = len(low), self.x[rows]
            if parent >= 0:
                self.children.setdefault(parent, []).append(node)
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            least.append(int(self.ids[rows].min()))
            side = int(np.argmax(high[-1] - low[-1]))
            if len(rows) <= LEAF or high[-1][side] == low[-1][side]:
                self.leaf[node] = np.sort(rows)
            else:
                middle = len(rows) // 2
                halves = np.argpartition(part[:, side], middle)
                todo += [(rows[halves[:middle]], node), (rows[halves[middle:]], node)]
        self.low, self.high, self.least = np.array(low), np.array(high), least

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of each query's inner products with the points of every box."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, q: np.ndarray, bound: np.ndarray, own: int, k: int, floor: float) -> list[tuple[float, int]]:
        """The best (score, -id) of one query, at most k, none below the floor."""
        best: list[tuple[float, int]] = []  # a heap with the worst first
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            worst = best[0] if len(best) == k else (floor, NONE)
            if -b < worst[0]:
                break
            if (-b, -self.least[node]) < worst:
                continue
            if node in self.leaf:
                rows = self.leaf[node]
                scores = self.x[rows] @ q
                for i in np.flatnonzero(scores >= worst[0]).tolist():
                    item = (float(scores[i]), -int(self.ids[rows[i]]))
                    if item[1] == -own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            else:
                for child in self.children[node]:
                    if bound[child] >= worst[0]:
                        heapq.heappush(heap, (-bound[child], child))
        return best


def integers(rows: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """Rows (id, size, vec): floor(scale * x) of every component as bytes of 16-bit or, where needed, 64-bit integers.

    Rows that are null, empty or hold null or non-finite components, and rows with a null id, take no part. A component
    that 64 bits cannot hold raises OverflowError: no score of it would fit a long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False) * float(scale)
            if len(flat) == 0:
                continue
            edges = column.offsets.to_numpy().astype(np.int64)
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            there = np.asarray(batch.column(0).is_valid()) & np.asarray(column.is_valid())
            keep = np.flatnonzero(there & (np.diff(edges) > 0) & (wrong[edges[1:]] == wrong[edges[:-1]]))
            if not len(keep):
                continue
            low = np.floor(np.where(np.isfinite(flat), flat, 0.0))
            most = np.maximum.reduceat(np.append(np.abs(low), 0.0), edges[:-1])[keep]
            if most.max() >= 2.0**63:
                raise OverflowError("a component times the scale does not fit 64 bits")
            whole = low.clip(-(2.0**63), np.nextafter(2.0**63, 0)).astype("<i8")
            wide, narrow = whole.tobytes(), whole.astype("<i2").tobytes()
            cells = zip(edges[keep].tolist(), edges[keep + 1].tolist(), (most < 32767).tolist(), strict=True)
            vecs = [narrow[2 * a : 2 * b] if small else wide[8 * a : 8 * b] for a, b, small in cells]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), pa.array(np.diff(edges)[keep], pa.int32()), pa.array(vecs, pa.binary())],
                names=["id", "size", "vec"],
            )

    values = F.col(vector_column).cast("array<double>")
    return rows.select(F.col(id_column).cast("long").alias("id"), values.alias("v")).mapInArrow(run, "id long, size int, vec binary")


def _matrix(vecs: list[bytes], size: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<i2" if len(v) == 2 * size else "<i8").astype(np.int64) for v in vecs])


def _exact(x: np.ndarray, q: np.ndarray) -> bool:
    """Whether sums of products stay exact in doubles."""
    return float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < 2.0**53


def _large(tree: Tree, q: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
    """What ``Tree.search`` finds, in whole numbers of any size, for components beyond a double's exact sums."""
    scores = (tree.whole.astype(object) * q.astype(object)).sum(axis=1)
    found = [(int(s), -int(i)) for s, i in zip(scores, tree.ids, strict=True) if i != own and (floor is None or s >= floor)]
    best = heapq.nlargest(k, found)
    if any(not -(1 << 63) <= s < 1 << 63 for s, _ in best):
        raise OverflowError("an inner product does not fit 64 bits")
    return best


class Cells:
    """Cells of the space by median splits of a sample, for each dimension of vectors; unknown dimensions have one."""

    def __init__(self, sample: list[tuple[int, bytes]], cells: int):
        self.splits: dict[int, list[tuple[int, int, int, int]]] = {}  # side, value, left, right; a cell c is -1 - c
        for size in {s for s, _ in sample}:
            x = _matrix([v for s, v in sample if s == size], size)
            want = max(1, round(cells * len(x) / len(sample)))
            parts, splits, heap = [np.arange(len(x))], [], [(-len(x), 0, None)]  # heap: cell, and the split's slot naming it
            while heap and len(parts) < want:
                _, cell, slot = heapq.heappop(heap)
                rows = parts[cell]
                side = int(np.argmax(x[rows].max(axis=0) - x[rows].min(axis=0)))
                value = int(np.median(x[rows, side]))
                left = x[rows, side] <= value
                if len(rows) < 32 or left.all() or not left.any():
                    continue
                new, place = len(parts), len(splits)
                parts[cell] = rows[left]
                parts.append(rows[~left])
                splits.append([side, value, -1 - cell, -1 - new])
                if slot is not None:
                    splits[slot[0]][slot[1]] = place
                heapq.heappush(heap, (-len(parts[cell]), cell, (place, 2)))
                heapq.heappush(heap, (-len(parts[new]), new, (place, 3)))
            self.splits[size] = [tuple(s) for s in splits]

    def of(self, x: np.ndarray) -> np.ndarray:
        splits = self.splits.get(x.shape[1])
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if splits else []
        while todo:
            node, rows = todo.pop()
            side, value, left, right = splits[node]
            low = x[rows, side] <= value
            for child, part in ((left, rows[low]), (right, rows[~low])):
                if child >= 0:
                    todo.append((child, part))
                else:
                    out[part] = -1 - child
        return out


def _place(given: DataFrame, cells: Cells) -> DataFrame:
    """Rows (size, cell, id, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                cell = cells.of(_matrix(part.column(2).to_pylist(), size))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(cell.astype(np.int32)), part.column(0), part.column(2)], names=["size", "cell", "id", "vec"]
                )

    return given.mapInArrow(run, "size int, cell int, id long, vec binary")


def _groups(batches: Iterator[pa.RecordBatch], asked: str) -> Iterator[tuple[tuple, bool, pa.Table]]:
    """Stretches of rows sorted by (shard, size, asked): the key, whether they are queries, and the rows."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        keys = [t.column("shard").to_numpy(), t.column("size").to_numpy(), t.column(asked).to_numpy(zero_copy_only=False)]
        change = np.zeros(max(t.num_rows - 1, 0), bool)
        for x in keys:
            change |= x[1:] != x[:-1]
        for a, b in pairwise([0, *(np.flatnonzero(change) + 1).tolist(), t.num_rows]):
            if a < b:
                yield (int(keys[0][a]), int(keys[1][a])), bool(keys[2][a]), t.slice(a, b - a)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(C.shards(rows), "shard").sortWithinPartitions("shard", "size", "asks")


def _search(rows: DataFrame, k: int) -> DataFrame:
    """Rows (shard, size, asks, id, floor, vec): streams queries against each shard's tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, data, tree = None, [], None
        for key, asks, part in _groups(batches, "asks"):
            if key != at:
                at, data, tree = key, [], None
            if not asks:
                data.append((part.column("id").to_numpy(), _matrix(part.column("vec").to_pylist(), key[1])))
                continue
            if tree is None:
                if not data:
                    continue
                tree, data = Tree(np.concatenate([i for i, _ in data]), np.concatenate([x for _, x in data])), []
            for c in range(0, part.num_rows, 512):
                t = part.slice(c, 512)
                q = _matrix(t.column("vec").to_pylist(), key[1])
                own, floors = t.column("id").to_pylist(), t.column("floor").to_pylist()
                out: list[tuple[int, int, int]] = []
                if _exact(tree.x, q):
                    q = q.astype(np.float64)
                    bounds = tree.bounds(q)
                    for i, o in enumerate(own):
                        floor = float("-inf") if floors[i] is None else float(floors[i])
                        out += [(o, -j, int(s)) for s, j in tree.search(q[i], bounds[i], o, k, floor)]
                else:
                    for i, o in enumerate(own):
                        out += [(o, -j, s) for s, j in _large(tree, q[i], o, k, floors[i])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], names=["query_id", "vec_id", "score"]
                )

    return _dealt(rows).mapInArrow(run, "query_id long, vec_id long, score long")


def _boxes(data: DataFrame) -> DataFrame:
    """Rows (shard, size, low, high): every shard's bounding box, from one box for each task and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for key, _, part in _groups(batches, "asks"):
            x = _matrix(part.column("vec").to_pylist(), key[1])
            low, high = x.min(axis=0), x.max(axis=0)
            if key in held:
                low, high = np.minimum(low, held[key][0]), np.maximum(high, held[key][1])
            held[key] = [low, high]
        if held:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int32()),
                    *(pa.array([b[i].astype("<i8").tobytes() for b in held.values()], pa.binary()) for i in (0, 1)),
                ],
                names=["shard", "size", "low", "high"],
            )

    # a shard's rows are together in one partition, so its box is whole
    return _dealt(data).select("shard", "size", "asks", "vec").mapInArrow(run, "shard long, size int, low binary, high binary")


def _reach(asks: DataFrame, boxes: DataFrame, chunks: int) -> DataFrame:
    """Rows (id, shard, bound): shards other than a query's own whose box may hold its kth score or better.

    Boxes are dealt into chunks of some thousands; a query is copied once for each chunk, not for each shard.
    """
    spread = boxes.select(
        F.pmod(F.xxhash64("shard"), F.lit(chunks)).alias("chunk"), "size", F.lit(False).alias("asks"), "shard", F.lit(None).cast("long").alias("id"),
        F.lit(None).cast("long").alias("floor"), "low", "high",
    )
    queries = asks.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "size", F.lit(True).alias("asks"), "shard", "id", "floor",
        F.col("vec").alias("low"), F.lit(None).cast("binary").alias("high"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard, low, high = None, [], None, None, None
        for key, asks, part in _groups(batches, "asks"):
            if key != at:
                at, held, low = key, [], None
            if not asks:
                held.append(part)
                continue
            if low is None:
                t = pa.concat_tables(held) if held else None
                if t is None:
                    continue
                shard = t.column("own").to_numpy()
                low, high = (np.stack([np.frombuffer(v, "<i8") for v in t.column(c).to_pylist()]).astype(np.float64) for c in ("low", "high"))
            for c in range(0, part.num_rows, 256):
                t = part.slice(c, 256)
                q = _matrix(t.column("low").to_pylist(), key[1]).astype(np.float64)
                bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                # beyond exact sums a bound may be rounded down: allow for it
                bound += np.abs(bound) * 1e-12 + 64 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T) * 2.0**-52
                floor = t.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                floor = np.where(np.isnan(floor), -np.inf, floor)
                i, j = np.nonzero((bound >= floor[:, None]) & (t.column("own").to_numpy()[:, None] != shard[None, :]))
                yield pa.RecordBatch.from_arrays(
                    [t.column("id").combine_chunks().take(pa.array(i)), pa.array(shard[j]), pa.array(bound[i, j])], names=["id", "shard", "bound"]
                )

    both = spread.unionByName(queries).withColumnRenamed("shard", "own").withColumnRenamed("chunk", "shard")
    return _dealt(both).mapInArrow(run, "id long, shard long, bound double")


def _floors(found: DataFrame, k: int) -> DataFrame:
    """Rows (id, floor): the kth score so far of every query that has k results."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    return best.select(F.col("query_id").alias("id"), F.col("score").alias("floor"))


def top_k(
    rows: DataFrame,
    k: int = 10,
    every: int = 100,
    scale: int = 1024,
    shard_rows: int = 8192,
    sample_rows: int = 16384,
    first_shards: int = 8,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row whose id is divisible by ``every`` the k other rows with
    the largest inner product of floor(scale * x), ties to the smaller id; all, if there are fewer.

    sample_rows: vectors (those with the smallest hash of their id) that the splits are taken from; the driver holds no
    more. first_shards: shards of the second wave.

    Vectors meet only vectors of their own dimension. A row never meets a row of its own id; repeated rows of one id
    count each. See ``integers`` for what takes no part. An empty table gives no rows. Other columns are ignored.
    """
    given = integers(rows, scale, id_column, vector_column)
    n = given.count()
    sample = given.select("size", "vec").orderBy(F.xxhash64("id")).limit(sample_rows).collect() if n > shard_rows else []
    cells = Cells([(r["size"], r["vec"]) for r in sample], min(-(-n // shard_rows), max(1, len(sample) // 16)))
    placed = C.table(_place(given, cells), "vectors-by-cell")
    parts = placed.groupBy("size", "cell").agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    data = placed.join(parts, ["size", "cell"]).select(
        F.xxhash64("size", "cell", F.pmod(F.xxhash64("id"), "parts")).alias("shard"), "size", F.lit(False).alias("asks"), "id",
        F.lit(None).cast("long").alias("floor"), "vec",
    )
    data = C.table(data, "vectors-by-shard")
    asks = data.where(F.col("id") % every == 0).withColumn("asks", F.lit(True)).distinct()
    found = C.table(_search(data.unionByName(asks), k), "own-shard")
    if n > shard_rows or len(cells.splits) > 1:
        known = asks.drop("floor").join(_floors(found, k), "id", "left")
        chunks = max(1, -(-n // (shard_rows * 2048)))
        reach = C.table(_reach(known, _boxes(data), chunks), "shards-in-reach")
        nth = Window.partitionBy("id").orderBy(F.desc("bound"), "shard")
        ranked = C.table(reach.withColumn("nth", F.row_number().over(nth)), "shards-by-bound")
        for wave in (F.col("nth") <= first_shards, F.col("nth") > first_shards):
            to = ranked.where(wave).join(_floors(found, k), "id", "left").where("floor is null or bound >= floor")
            to = to.select("id", "shard", "floor").join(asks.select("id", "size", "asks", "vec"), "id")
            more = _search(data.unionByName(to.select(data.columns)), k)
            found = C.table(found.unionByName(more), "waves")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


#: The same rows in SQL for the defaults.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 10
"""
