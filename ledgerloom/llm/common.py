"""Shared parts of the training-data operators: the shared folder, text buffers, packed sorted arrays.

Text operators that need word boundaries or hashes work on the UTF-8 buffer of a whole Arrow batch with numpy, so
no Python object is made per word. Large intermediate arrays travel as binary blobs, one row per task and shard.
"""

from __future__ import annotations

import atexit
import ctypes
import mmap
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Bytes of text that are turned into arrays at a time; a longer document is taken whole.
CHUNK_BYTES = 2 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


# ---------------------------------------------------------------------------------------------- shared folder
def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a session in local mode,
    as in tests, gets a folder of its machine; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        _FOLDERS.append(root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_FOLDERS: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder; nothing else uses it. ``release`` deletes it."""
    _FOLDERS.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def release() -> None:
    """Delete all folders that this process has made; frames that read them are of no use afterwards. Runs at exit."""
    while _FOLDERS:
        try:
            fs, path, _ = _fs(_FOLDERS.pop())
            fs.delete_dir(path)
        except (OSError, pa.ArrowException):
            pass  # never written, or on a store that only Spark can open


atexit.register(release)


def table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a frame to the shared folder and read it again: later steps survive the loss of executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of stored input for which one more shard is made.
SHARD_BYTES = 1 << 30


def shards(df: DataFrame) -> int:
    """How many shards arrays are dealt to: one for each GB that the frame's sources hold, and never fewer than the
    session's shuffle partitions."""
    least = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(least, -(-sum(n for n in sizes if n < 1 << 55) // SHARD_BYTES))  # larger: a source that knows no size


def ranked(df: DataFrame, column: str, name: str = "ranks") -> DataFrame:
    """Distinct non-null values of a column and their place in order (rank long from 0), without a single sorted task:
    sorted ranges are counted, and a range begins where those before it end."""
    kind = df.schema[column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(held, held + n))], names=["v", "part", "at"])
            held += n

    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct()
    placed = table(values.repartitionByRange(shards(df), "v").sortWithinPartitions("v").mapInArrow(run, f"v {kind}, part int, at long"), name)
    sizes = sorted(tuple(r) for r in placed.groupBy("part").count().collect())  # one row per range
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    begins = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part int, begin long")
    return placed.join(F.broadcast(begins), "part").select(F.col("v").alias(column), (F.col("begin") + F.col("at")).alias("rank"))


# ---------------------------------------------------------------------------------------------- array files
def _fs(uri: str) -> tuple[pafs.FileSystem, str, bool]:
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/"), True
        fs, path = pafs.FileSystem.from_uri(uri)
        return fs, path, False
    return pafs.LocalFileSystem(), uri, True


def put_array(uri: str, values: np.ndarray) -> None:
    """Write an array to the shared folder under its final name in one step, so a repeated task does no harm."""
    fs, path, local = _fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(values).view(np.uint8).data if len(values) else b"")
    if local:
        os.replace(part, path)
    else:
        fs.move(part, path)


def get_array(uri: str, dtype) -> np.ndarray:
    """Memory-map an array of the shared folder; a store that has no mount is read into memory instead."""
    fs, path, local = _fs(uri)
    if not local:
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read_buffer(), dtype=dtype)
    if os.path.getsize(path) == 0:
        return np.empty(0, dtype=dtype)
    with open(path, "rb") as f:
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype=dtype)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Return a worker's free memory to the system. Workers are kept for later stages, and an executor's limit counts what
    all of them hold."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


# ---------------------------------------------------------------------------------------------- text buffers
def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold fewer rows, so that long texts do not add up in a worker; applies to the session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_chunks(batch: pa.RecordBatch, column: str | int = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, bytes, offsets) of a batch of about CHUNK_BYTES; null texts are empty."""
    texts = pc.fill_null(batch.column(column), "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the words ``[^\\x20\\x09-\\x0D]+``, or of runs of bytes that are not ``between``; a
    word never crosses documents."""
    if not len(data):
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    solid = ~between[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets[(offsets >= 0) & (offsets <= len(data))]] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    per_doc = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), per_doc)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS: list[np.ndarray] = [np.empty(0, U), np.empty(0, U)]
_BLOCK = 1 << 15
_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: a polynomial over random byte values by prefix sums, then mixed with the length."""
    if len(_POWERS[0]) < len(data) + 1:
        n = max(len(data) + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=U)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    sums = np.empty(len(data) + 1, dtype=U)
    sums[0] = 0
    for a in range(0, len(data), _BLOCK):  # blocks that stay in the processor's cache
        part = slice(a + 1, min(a + _BLOCK, len(data)) + 1)
        np.take(_BYTE, data[a : a + _BLOCK], out=sums[part], mode="clip")
        sums[part] *= _POWERS[0][a : a + _BLOCK][: part.stop - part.start]
        sums[part.start : part.start + 1] += sums[a : a + 1]
        np.cumsum(sums[part], out=sums[part])
    h = (sums[ends] - sums[starts]) * _POWERS[1][starts]
    return mix(h + mix((ends - starts).astype(U)))


def second_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges that share nothing with ``word_hashes``: the sum of a random value for each byte and
    its place in the range, mixed with the length. Ranges of about two blocks of bytes are hashed at a time."""
    sizes = ends - starts
    upto = np.cumsum(sizes)
    out = np.empty(len(sizes), U)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] - sizes[a] + 2 * _BLOCK)))
        n, stop = sizes[a:b], upto[a:b] - (upto[a] - sizes[a])
        within = np.arange(stop[-1]) - np.repeat(stop - n, n)
        raw = data[within + np.repeat(starts[a:b], n)].astype(U)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix((within.astype(U) << U(8) | raw) * U(_BASE) + U(_BASE)))])
        out[a:b] = mix(sums[stop] - sums[stop - n] + mix(n.astype(U)))
        a = b
    return out


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and for every item the number of its value; by hashing, not sorting."""
    codes, values = pd.factorize(h)
    place = np.empty(len(values), np.int64)
    place[codes] = np.arange(len(h))
    order = np.argsort(values)
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return values[order], place[order], rank[codes]


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each comes."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the 64-bit space, so that shards in order hold hashes in order."""
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


def cut(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n shards begins in an array of sorted hashes, and its end."""
    return np.searchsorted(shard_of(sorted_hashes, n), np.arange(n + 1), side="left")


# ---------------------------------------------------------------------------------------------- components
#: Edges that a task joins by itself before components are joined across tasks; only the speed depends on it.
TASK_EDGES = 1 << 18


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of a task as stars: each id but the smallest of those that they join, and that one."""
    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_forest(len(ids), at[: len(a)], at[len(a) :])
        far = np.flatnonzero(root != np.arange(len(ids)))
        for part in (far[i : i + 65536] for i in range(0, len(far), 65536)):
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(ids[root[part]])], names=["a", "b"])
        del held, a, b, ids, at, root, far
        give_back()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected edges (a, b long) as rows (id, root): root is the smallest id reachable.

    Tasks first join ``TASK_EDGES`` edges or so each, so that few edges need no further step: every step costs the driver
    two queries. Then alternating large-star and small-star steps: every step maps edges to edges, keeps connectivity and
    ends with a star around each component's smallest id, in a number of steps that grows as the logarithm squared at most.
    Each step pre-aggregates minima; a hub's edges are never gathered into a list, only joined to one minimum. Each
    step is written to the shared folder. Ids without an edge have no row; the caller keeps them as their own root.
    """
    edges = table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    tell = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    tasks = -(-edges.count() // TASK_EDGES)
    if tasks:
        edges = table(edges.coalesce(tasks).mapInArrow(_contracted, "a long, b long"), name)
    state = edges.select(tell).first()[0] if tasks > 1 else {"n": 0}  # what one task has joined is done
    while state["n"]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # large star: every larger neighbour of a now points to the smallest of a and its neighbours
        large = (
            both.join(low, "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        # small star: a and every smaller neighbour point to the smallest of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        after = (
            large.join(small, "a")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            .select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        after = table(after, name)
        before, state, edges = state, after.select(tell).first()[0], after
        if state == before:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def local_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of n local items joined by index pairs: minimum label propagation with pointer jumping."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(root, before):
            break
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


