"""Interpolated modified Kneser-Ney bigram model, counted in Spark, stored as sorted hash arrays, memory-mapped.

Words are counted per task and meet by ranges of their 64-bit hash; a word's number is its place in the sorted
hashes of all shards. Bigrams (context number, word number) are counted per task and meet by context; contexts that
hold more than a quarter of a mean shard are dealt by the whole bigram instead, so no shard is hot. Every shard is
written as sorted arrays to the shared folder. Context totals and continuation counts are dense arrays by number.
Workers memory-map the arrays and look up each chunk's distinct words and bigrams in sorted order.

Counts cover all training text; nothing is pruned. Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case,
then one end token a document. Null and empty texts have the end token only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Hash of the end token; no word hashes to it but by the chance of any 64-bit collision.
END_HASH = C.U(0xE0D5A1B2C3F40917)
_MERGE = 4_000_000


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    k, c = np.concatenate([np.empty(0, C.U), *keys]), np.concatenate([np.empty(0, np.int64), *counts])
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], (np.add.reduceat(c, first) if len(first) else c)


class Counter:
    """Counts of 64-bit keys within a task, merged whenever enough have come."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = C.tally(keys)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > _MERGE and len(self.keys) > 1:
            k, c = merge(self.keys, self.counts)
            self.keys, self.counts, self.held = [k], [c], len(k) // 2

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return merge(self.keys, self.counts)


def narrow(counts: np.ndarray) -> bytes:
    """Counts as bytes: one byte each, those of 255 and more as eight bytes after all of them."""
    big = counts >= 255
    return np.where(big, 255, counts).astype(np.uint8).tobytes() + counts[big].astype(np.int64).tobytes()


def widen(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.int64, offset=n)
    return out


def discounts(n: np.ndarray) -> np.ndarray:
    """The three modified discounts from the numbers of items seen once to four times."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if min(n1, n2, n3) <= 0:
        return np.array([0.0, 0.75, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(x, 0.0), float(k + 1)) for k, x in enumerate(d))])


@dataclass
class Model:
    """Where the arrays are, and the few numbers that every worker needs."""

    folder: str
    n: int
    sizes: np.ndarray  # words of each shard
    stored: frozenset[str] = frozenset()  # arrays that were written, as kind and shard; a missing file of one is an error
    tokens: int = 0
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    bigram_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    word_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    continuations: np.ndarray = field(default_factory=lambda: np.zeros(5))  # types seen once, twice, more; all; bigram types

    def __post_init__(self):
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.words = int(self.starts[-1])
        self.begin, self.unknown = self.words, self.words + 1
        if self.unknown >= 1 << 32:
            raise OverflowError("bigram keys hold word numbers of 32 bits; this corpus has more distinct words")
        self.cache: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def array(self, name: str, dtype) -> np.ndarray:
        if name not in self.cache:
            there = name.split(".")[0] in self.stored
            self.cache[name] = C.get_array(f"{self.folder}/{name}", dtype) if there else np.empty(0, dtype)
        return self.cache[name]

    def number(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of sorted word hashes; unknown words have count 0."""
        ids, counts = np.full(len(hashes), self.unknown, np.int64), np.zeros(len(hashes), np.int64)
        edges = C.cut(hashes, self.n)
        for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            keys = self.array(f"word{k}.hash", C.U)
            if len(keys):
                part = slice(edges[k], edges[k + 1])
                at = np.minimum(np.searchsorted(keys, hashes[part]), len(keys) - 1)
                hit = keys[at] == hashes[part]
                ids[part] = np.where(hit, at + self.starts[k], self.unknown)
                counts[part] = np.where(hit, self.array(f"word{k}.count", np.int64)[at], 0)
        return ids, counts

    def shard(self, keys: np.ndarray) -> np.ndarray:
        context = (keys >> C.U(32)).astype(np.int64)
        spread = np.isin(context, self.hot)
        return C.shard_of(C.mix(np.where(spread, keys, context.astype(C.U) + C.U(1))), self.n)

    def bigrams(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted bigram keys."""
        out, shard = np.zeros(len(keys), np.int64), self.shard(keys)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.n + 1))
        for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            held = self.array(f"bigram{k}.key", C.U)
            if len(held):
                mine = order[edges[k] : edges[k + 1]]
                at = np.minimum(np.searchsorted(held, keys[mine]), len(held) - 1)
                count = np.where(held[at] == keys[mine], self.array(f"bigram{k}.count", np.uint8)[at], 0).astype(np.int64)
                big = count == 255
                if big.any():
                    where = np.searchsorted(self.array(f"bigram{k}.bigkey", C.U), keys[mine][big])
                    count[big] = self.array(f"bigram{k}.bigcount", np.int64)[where]
                out[mine] = count
        return out

    def range_of(self, ids: np.ndarray) -> np.ndarray:
        return ids * self.n // (self.words + 2)

    def range_start(self, k: int) -> int:
        return -(-k * (self.words + 2) // self.n)

    def dense(self, name: str, ids: np.ndarray, width: int) -> np.ndarray:
        """Rows of a dense table for sorted numbers."""
        out, k = np.zeros((len(ids), width), np.int64), self.range_of(ids)
        edges = np.searchsorted(k, np.arange(self.n + 1))
        for r in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            rows = self.array(f"{name}{r}", np.int64).reshape(-1, width)
            if len(rows):
                out[edges[r] : edges[r + 1]] = rows[ids[edges[r] : edges[r + 1]] - self.range_start(r)]
        return out

    def log10(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log10 probabilities of bigrams given by numbers."""
        keys, _, inverse = C.distinct(contexts.astype(C.U) << C.U(32) | words.astype(C.U))
        v, w = (keys >> C.U(32)).astype(np.int64), (keys & C.U(0xFFFFFFFF)).astype(np.int64)
        dw = self.word_discounts
        ids, _, back = C.distinct(w)
        seen = self.dense("continuation", ids, 1)[:, 0]
        once, twice, more, total, _ = self.continuations
        uniform = 1.0 / (self.words + 1)
        if total:
            left = (dw[1] * once + dw[2] * twice + dw[3] * more) / total
            lower = (np.maximum(seen - dw[np.minimum(seen, 3)], 0) / total + left * uniform)[back]
        else:
            lower = np.full(len(keys), uniform)
        ids, _, back = C.distinct(v)
        stats = self.dense("context", ids, 4)[back]
        count, d = self.bigrams(keys), self.bigram_discounts
        whole = stats[:, 0]
        spare = stats[:, 1] * d[1] + stats[:, 2] * d[2] + stats[:, 3] * d[3]
        upper = (np.maximum(count - d[np.minimum(count, 3)], 0) + spare * lower) / np.maximum(whole, 1)
        return np.log10(np.where(whole > 0, upper, lower))[inverse]


def _tokens(model: Model, data: np.ndarray, offsets: np.ndarray):
    """Numbers of contexts and of tokens, the tokens' counts, and where each document's begin."""
    low = C.LOWER[data]
    s, e, doc = C.words(low, offsets)
    h = np.append(C.word_hashes(low, s, e), END_HASH)
    distinct, _, inverse = C.distinct(h)
    ids, counts = model.number(distinct)
    docs = len(offsets) - 1
    ends = np.searchsorted(doc, np.arange(docs), side="right")
    token = np.insert(ids[inverse[:-1]], ends, ids[inverse[-1]])
    count = np.insert(counts[inverse[:-1]], ends, counts[inverse[-1]])
    at = np.concatenate([[0], ends + np.arange(1, docs + 1)])
    context = np.concatenate([[model.begin], token[:-1]])
    context[at[:-1]] = model.begin
    return context, token, count, at


def _blobs(shard: np.ndarray, n: int, columns: list) -> pa.RecordBatch:
    """One row per shard that has items; items must be sorted by shard. columns: functions of a slice, giving bytes."""
    edges = np.searchsorted(shard, np.arange(n + 1))
    full = np.flatnonzero(edges[1:] > edges[:-1]).tolist()
    parts = [slice(edges[k], edges[k + 1]) for k in full]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), *(pa.array([f(p) for p in parts], pa.binary()) for f in columns)],
        names=["shard", *"abc"[: len(columns)]],
    )


def train(docs: DataFrame, text_column: str = "text") -> Model:
    """Count a corpus and write the model's arrays to the shared folder.

    Null and empty texts count an end token. Repeated rows count each time. An empty corpus gives a model without words
    in which every word is unknown and all tokens are equally likely. Raises OverflowError beyond 2^32 distinct words.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    n, folder = C.shards(docs), C.shared_folder(spark, "kneser-ney")
    docs = docs.select(F.col(text_column).cast("string").alias("text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for _, _, data, offsets in C.text_chunks(batch):
                low = C.LOWER[data]
                s, e, _ = C.words(low, offsets)
                counter.add(C.word_hashes(low, s, e))
                counter.add(np.array([END_HASH]), np.array([len(offsets) - 1]))
        keys, counts = counter.result()
        if len(keys):
            yield _blobs(C.shard_of(keys, n), n, [lambda p: keys[p].tobytes(), lambda p: narrow(counts[p])])

    def store_words(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["shard"].iloc[0])
        found = [np.frombuffer(x, C.U) for x in pdf["a"]]
        keys, counts = merge(found, [widen(x, len(f)) for x, f in zip(pdf["b"], found, strict=True)])
        C.put_array(f"{folder}/word{k}.hash", keys)
        C.put_array(f"{folder}/word{k}.count", counts)
        level = max(1, int(counts.sum()) // 64)
        heavy = counts > level  # only candidates for hot contexts; at most 64 a shard
        return pd.DataFrame({
            "shard": [k], "size": [len(keys)], "total": [int(counts.sum())],
            "place": [np.flatnonzero(heavy).tolist()], "count": [counts[heavy].tolist()],
        })

    shards = (
        docs.mapInArrow(count_words, "shard int, a binary, b binary")
        .groupBy("shard")
        .applyInPandas(store_words, "shard int, size long, total long, place array<long>, count array<long>")
        .collect()
    )  # one row per shard
    sizes = np.zeros(n, np.int64)
    for r in shards:
        sizes[r["shard"]] = r["size"]
    stored = frozenset(f"word{r['shard']}" for r in shards)
    model = Model(folder, n, sizes, stored, tokens=sum(r["total"] for r in shards))
    limit = model.tokens / (4 * n)
    hot = [int(model.starts[r["shard"]]) + p for r in shards for p, c in zip(r["place"], r["count"], strict=True) if c > limit]
    model.hot = np.array([*hot, model.begin], np.int64)

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for _, _, data, offsets in C.text_chunks(batch):
                context, token, _, _ = _tokens(model, data, offsets)
                counter.add(context.astype(C.U) << C.U(32) | token.astype(C.U))
        keys, counts = counter.result()
        if len(keys):
            shard = model.shard(keys)
            order = np.argsort(shard, kind="stable")
            keys, counts = keys[order], counts[order]

            def contexts(p: slice) -> bytes:
                v, size = np.unique((keys[p] >> C.U(32)).astype(np.uint32), return_counts=True)
                return np.int64(len(v)).tobytes() + v.tobytes() + narrow(size)

            def followers(p: slice) -> bytes:
                return (keys[p] & C.U(0xFFFFFFFF)).astype(np.uint32).tobytes()

            yield _blobs(shard[order], n, [contexts, followers, lambda p: narrow(counts[p])])

    def unpack(a: bytes, b: bytes) -> np.ndarray:
        size = int(np.frombuffer(a, np.int64, 1)[0])
        v = np.frombuffer(a, np.uint32, size, offset=8).astype(C.U)
        return np.repeat(v, widen(a[8 + 4 * size :], size)) << C.U(32) | np.frombuffer(b, np.uint32).astype(C.U)

    def store_bigrams(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["shard"].iloc[0])
        found = [unpack(a, b) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
        keys, counts = merge(found, [widen(x, len(f)) for x, f in zip(pdf["c"], found, strict=True)])
        big = counts >= 255
        C.put_array(f"{folder}/bigram{k}.key", keys)
        C.put_array(f"{folder}/bigram{k}.count", np.where(big, 255, counts).astype(np.uint8))
        C.put_array(f"{folder}/bigram{k}.bigkey", keys[big])
        C.put_array(f"{folder}/bigram{k}.bigcount", counts[big].astype(np.int64))
        v = (keys >> C.U(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        stats = np.stack(
            [np.add.reduceat(x.astype(np.int64), first) for x in (counts, counts == 1, counts == 2, counts > 2)], axis=1
        )
        w, types = np.unique((keys & C.U(0xFFFFFFFF)).astype(np.int64), return_counts=True)
        rows = [("seen", k, b"", np.array([(counts == i).sum() for i in range(1, 5)], np.int64).tobytes())]
        for kind, ids, values in (("context", v[first], stats), ("continuation", w, types.astype(np.int64)[:, None])):
            edges = np.searchsorted(model.range_of(ids), np.arange(n + 1))
            for r in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                p = slice(edges[r], edges[r + 1])
                rows.append((kind, r, ids[p].astype(np.uint32).tobytes(), values[p].astype(np.uint32 if values.max() < 1 << 32 else np.uint64).tobytes()))
        return pd.DataFrame(rows, columns=["kind", "shard", "a", "b"])

    def store_dense(pdf: pd.DataFrame) -> pd.DataFrame:
        r, start = int(pdf["shard"].iloc[0]), model.range_start(int(pdf["shard"].iloc[0]))
        size = model.range_start(r + 1) - start
        tables = {"context": np.zeros((size, 4), np.int64), "continuation": np.zeros((size, 1), np.int64)}
        for kind, a, b in zip(pdf["kind"], pdf["a"], pdf["b"], strict=True):
            ids, width = np.frombuffer(a, np.uint32).astype(np.int64) - start, tables[kind].shape[1]
            dtype = np.uint32 if len(b) == 4 * width * len(ids) else np.uint64
            tables[kind][ids] += np.frombuffer(b, dtype).reshape(-1, width).astype(np.int64)  # ids are distinct in a blob
        for kind, values in tables.items():
            C.put_array(f"{folder}/{kind}{r}", values.reshape(-1))
        c = tables["continuation"][:, 0]
        out = {"shard": [r]} | {f"n{i}": [int((c == i).sum())] for i in range(1, 5)}
        return pd.DataFrame(out | {"types": [int((c > 0).sum())], "total": [int(c.sum())]})

    sums = C.table(
        docs.mapInArrow(count_bigrams, "shard int, a binary, b binary, c binary")
        .groupBy("shard")
        .applyInPandas(store_bigrams, "kind string, shard int, a binary, b binary"),
        "kneser-ney-sums",
    )
    bigrams = sums.where("kind = 'seen'").select("shard", "b").collect()  # one row per shard
    seen = [np.frombuffer(r["b"], np.int64) for r in bigrams]
    dense = (
        sums.where("kind <> 'seen'")
        .groupBy("shard")
        .applyInPandas(store_dense, "shard int, n1 long, n2 long, n3 long, n4 long, types long, total long")
        .collect()
    )  # one row per range
    model.bigram_discounts = discounts(np.sum(seen, axis=0) if seen else np.zeros(4))
    n1, n2, n3, n4, types, total = (sum(r[i] for r in dense) for i in range(1, 7))
    model.stored |= {f"bigram{r['shard']}" for r in bigrams}
    model.stored |= {f"{kind}{r['shard']}" for r in dense for kind in ("context", "continuation")}
    model.word_discounts = discounts(np.array([n1, n2, n3, n4]))
    model.continuations = np.array([n1, n2, types - n1 - n2, total, types], np.float64)
    return model


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, n_tokens, n_known, base_score, score): token counts and log10 probabilities of whole texts.

    perplexity of a text is ``10 ** (-score / n_tokens)``. Rows with equal or null ids are scored one by one.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in C.text_chunks(batch):
                context, token, count, at = _tokens(model, data, offsets)
                base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
                sums = [np.add.reduceat(x, at[:-1]) for x in ((count > 0).astype(np.int64), base, model.log10(context, token))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(np.diff(at)), *(pa.array(x) for x in sums)],
                    names=["id", "n_tokens", "n_known", "base_score", "score"],
                )

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    scored = rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumnRenamed("id", id_column)


def held_out(id_column: str = "doc_id", folds: int = 5, fold: int = 1):
    """The fold that a model is not trained on, by the CRC-32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds == fold
