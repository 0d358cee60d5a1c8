"""Substring deduplication by recompression.

Words are the first symbols. Runs of a word, then pairs of neighbours, round after round, are named by 64-bit hashes
of what they hold, so every task gives equal strings equal names without asking others. A pair is joined when its
left symbol falls into the left half of that round's alphabet and its right symbol into the right half; so whether
two symbols join depends on them alone, and equal substrings have equal symbols inside. Each symbol carries the words
on which its existence depends; only a symbol whose dependence lies within a window says something about the window.

Three narrow passes over the texts; only hashes move between tasks, counted per task before they do:

1. Symbols of the last round are counted over the corpus; those seen twice or more are kept as sorted arrays. Texts
   that are equal as a whole are found by their word sequence.
2. A window with a determined symbol that is not shared cannot repeat. All other windows are named by 96 bits of
   their words, of two hashes of each that don't depend on one another; the earliest place of each that repeats is kept as sorted arrays. Whole copies of an earlier document
   are not looked at: each of their windows starts earlier.
3. Windows that are not the earliest of their name cover words to remove.

The result is exact but for collisions of 96-bit names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import spread

ROUNDS = 4
_P = 0x9E3779B97F4A7C15
LAST = np.iinfo(np.int64).max


@dataclass
class Symbols:
    """Symbols of a chunk in order: names, first word, word after the last, and the words that each depends on."""

    name: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray


def runs(h: np.ndarray, doc: np.ndarray) -> Symbols:
    """Maximal runs of equal words; a run depends on the word before and after it, or on the document's edge."""
    n = len(h)
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
    end = np.append(first[1:], n)
    size = end - first
    name = np.where(size > 1, C.mix(h[first] ^ (size.astype(C.U) * C.U(_P))), h[first])
    return Symbols(name, doc[first], first, end, first - 1, end + 1)


def pairs(s: Symbols, turn: int) -> Symbols:
    """Join every neighbouring pair of a left and a right symbol."""
    n = len(s.name)
    right = (C.mix(s.name ^ C.U(0xABCDEF + 7919 * turn)) & C.U(1)).astype(bool)
    same = np.append(s.doc[1:] == s.doc[:-1], False)
    joins = ~right & same & np.append(right[1:], False)
    joined = np.concatenate([[False], joins[:-1]])
    # a left symbol that stays alone depends on the next symbol, a right one on the symbol before
    after = np.where(same, np.append(s.high[1:], 0), s.end + 1)
    before = np.where(np.concatenate([[False], same[:-1]]), np.concatenate([[0], s.low[:-1]]), s.start - 1)
    alone = ~joins & ~joined
    low = np.where(alone & right, np.minimum(s.low, before), s.low)
    high = np.where(alone & ~right, np.maximum(s.high, after), s.high)
    k = np.flatnonzero(~joined)
    j = np.where(joins[k], np.minimum(k + 1, n - 1), k)
    name = np.where(joins[k], C.mix(s.name[k] * C.U(_P) + C.mix(s.name[j])), s.name[k])
    return Symbols(name, s.doc[k], s.start[k], s.end[j], np.minimum(low[k], low[j]), np.maximum(high[k], high[j]))


def parse(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    s = runs(h, doc)
    for turn in range(rounds):
        s = pairs(s, turn)
    return s


def candidates(s: Symbols, shared: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Starts of windows within one document that hold no determined symbol that is not shared."""
    n = len(doc) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    first, last = np.maximum(s.high - window, 0), np.minimum(s.low, n - 1)
    lone = ~shared & (last >= first)
    marks = np.bincount(first[lone], minlength=n + 1)[: n + 1] - np.bincount(last[lone] + 1, minlength=n + 1)[: n + 1]
    whole = doc[:n] == doc[window - 1 :]
    return np.flatnonzero((np.cumsum(marks)[:n] == 0) & whole)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, C.U)
    steps[:1] = 1
    return np.cumprod(steps)


def _rolling(h: np.ndarray, window: int) -> np.ndarray:
    powers, back = _powers(_P, len(h) + 1), _powers(pow(_P, -1, 1 << 64), len(h) + 1)
    sums = np.concatenate([np.zeros(1, C.U), np.cumsum(C.mix(h) * powers[:-1])])
    n = max(len(h) - window + 1, 0)
    return (sums[window:] - sums[: len(sums) - window])[:n] * back[:n]


def window_names(h: np.ndarray, g: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 bits from the words' first hashes and 32 from their second ones, naming the words of every window."""
    if len(h) < window:
        return np.empty(0, C.U), np.empty(0, np.uint32)
    return C.mix(_rolling(h, window)), (C.mix(_rolling(g, window)) >> C.U(32)).astype(np.uint32)


def document_names(h: np.ndarray, g: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each document's word sequence, from the words' first and from their second hashes."""
    size = np.bincount(doc, minlength=docs)
    first = np.cumsum(size) - size
    place = (np.arange(len(h)) - first[doc] + 1).astype(C.U) * C.U(_P)
    out = []
    for x in (h, g):
        sums = np.concatenate([np.zeros(1, C.U), np.cumsum(C.mix(C.mix(x ^ C.U(0x1234567)) + place))])
        out.append(C.mix(sums[first + size] - sums[first] + size.astype(C.U)))
    return out[0], out[1]


class Arrays:
    """The sorted arrays of the shared folder, mapped when first used. ``stored`` names the shards that were written; a
    missing file of one of them is an error."""

    def __init__(self, folder: str, n: int, stored: frozenset[str]):
        self.folder, self.n, self.stored, self.held = folder, n, stored, {}

    def get(self, name: str, dtype) -> np.ndarray:
        if name not in self.held:
            there = name.split(".")[0] in self.stored
            self.held[name] = C.get_array(f"{self.folder}/{name}", dtype) if there else np.empty(0, dtype)
        return self.held[name]

    def places(self, kind: str, keys: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """For each shard that sorted keys fall into: its number, the keys' slice, their places and which are there."""
        edges = C.cut(keys, self.n)
        for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            held, part = self.get(f"{kind}{k}.key", C.U), slice(edges[k], edges[k + 1])
            if len(held):
                at = np.minimum(np.searchsorted(held, keys[part]), len(held) - 1)
                yield k, part, at, held[at] == keys[part]

    def shared(self, names: np.ndarray) -> np.ndarray:
        keys, _, inverse = C.distinct(names)
        out = np.zeros(len(keys), bool)
        for _, part, _, hit in self.places("symbol", keys):
            out[part] = hit
        return out[inverse]

    def copies(self, a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Which documents are whole copies of one with a smaller id."""
        out, by = np.zeros(len(a), bool), np.argsort(a, kind="stable")
        for k, part, at, _ in self.places("document", a[by]):
            held, check, least = self.get(f"document{k}.key", C.U), self.get(f"document{k}.check", C.U), self.get(f"document{k}.least", np.int64)
            mine = by[part]
            at = np.searchsorted(held, a[mine])
            while True:  # names of 64 bits that collide stand one after the other
                inside = at < len(held)
                safe = np.minimum(at, len(held) - 1)
                here = inside & (held[safe] == a[mine])
                match = here & (check[safe] == b[mine])
                out[mine[match]] = least[safe[match]] < order[mine[match]]
                go = here & ~match
                if not go.any():
                    break
                mine, at = mine[go], at[go] + 1
        return out

    def later(self, name: np.ndarray, check: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which windows also start earlier, in an earlier document or before in the same."""
        out, by = np.zeros(len(name), bool), np.argsort(name, kind="stable")
        for k, part, _, _ in self.places("window", name[by]):
            held = self.get(f"window{k}.key", C.U)
            checks, docs, starts = self.get(f"window{k}.check", np.uint32), self.get(f"window{k}.doc", np.int64), self.get(f"window{k}.start", np.uint32)
            mine = by[part]
            at = np.searchsorted(held, name[mine])
            while True:
                inside = at < len(held)
                safe = np.minimum(at, len(held) - 1)
                here = inside & (held[safe] == name[mine])
                match = here & (checks[safe] == check[mine])
                i, m = safe[match], mine[match]
                out[m] = (docs[i] < doc[m]) | (docs[i] == doc[m]) & (starts[i] < start[m])
                go = here & ~match
                if not go.any():
                    break
                mine, at = mine[go], at[go] + 1
        return out


def _earliest(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by all keys, the first key first, and where a new pair of the first two keys begins."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def _cells(raw: bytes, n: int, *dtypes) -> list[np.ndarray]:
    out, at = [], 0
    for d in dtypes:
        out.append(np.frombuffer(raw, d, n, offset=at))
        at += n * np.dtype(d).itemsize
    return out


def remove_repeats(docs: DataFrame, window: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept: its words joined by one space without each word that lies
    in a window whose words also start earlier (smaller id; same document, earlier start). Windows are judged on the
    input.

    Null and empty texts have no words, long texts are taken whole. Ids may be of any kind that Spark can order. A null id
    comes after all others. Rows with equal ids stand at the same place: equal windows at equal starts of them do not
    count as earlier. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    n, folder = C.shards(docs), C.shared_folder(spark, "recompression")
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    if kind in ("tinyint", "smallint", "int", "bigint"):
        place = F.col("id").cast("long")
    else:  # ids of other kinds are ordered by their rank
        rows, place = rows.join(C.ranked(rows, "id"), "id", "left"), F.col("rank")
    docs = rows.select("id", F.coalesce(place, F.lit(LAST)).alias("place"), "text")

    def read(batch: pa.RecordBatch):
        for row, end, data, offsets in C.text_chunks(batch):
            s, e, doc = C.words(data, offsets)
            h, g = C.word_hashes(data, s, e), C.second_hashes(data, s, e)
            yield row, end, data, s, e, doc, h, g, batch.column(1).slice(row, end - row).to_numpy()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, _, _, _, doc, h, g, place in read(batch):
                if not len(h):
                    continue
                names, often = C.tally(parse(h, doc).name)
                a, b = document_names(h, g, doc, end - row)
                big = np.bincount(doc, minlength=end - row) >= window
                a, b, place = a[big], b[big], place[big]
                order = np.argsort(a, kind="stable")
                a, b, place = a[order], b[order], place[order]
                p, q = C.cut(names, n), C.cut(a, n)
                many = (often > 1).astype(np.uint8)
                rows = [(k, "symbol", _blob(names[p[k] : p[k + 1]], many[p[k] : p[k + 1]])) for k in np.flatnonzero(np.diff(p)).tolist()]
                rows += [(k, "document", _blob(*(x[q[k] : q[k + 1]] for x in (a, b, place)))) for k in np.flatnonzero(np.diff(q)).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)], names=["shard", "kind", "a"]
                )

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["shard"].iloc[0])
        cells = [_cells(x, len(x) // 9, C.U, np.uint8) for x in pdf["a"][pdf["kind"] == "symbol"]]
        names = np.concatenate([np.empty(0, C.U), *(c[0] for c in cells)])
        twice = np.concatenate([np.empty(0, np.uint8), *(c[1] for c in cells)]).astype(bool)
        keys, often = C.tally(np.concatenate([names, names[twice]]))
        C.put_array(f"{folder}/symbol{k}.key", keys[often > 1])
        cells = [_cells(x, len(x) // 24, C.U, C.U, np.int64) for x in pdf["a"][pdf["kind"] == "document"]]
        a, b, place = (np.concatenate([np.empty(0, t), *(c[i] for c in cells)]) for i, t in enumerate((C.U, C.U, np.int64)))
        order, first = _earliest([a, b, place])
        some = np.diff(np.append(first, len(a))) > 1  # only those that come twice
        first = order[first[some]]
        for name, x in (("key", a), ("check", b), ("least", place)):
            C.put_array(f"{folder}/document{k}.{name}", x[first])
        return pd.DataFrame({"shard": [k], "n": [len(keys)]})

    shared = docs.mapInArrow(count, "shard int, kind string, a binary").groupBy("shard").applyInPandas(share, "shard int, n long")
    first_pass = frozenset(f"{kind}{r['shard']}" for r in shared.collect() for kind in ("symbol", "document"))  # one row per shard

    def look(arrays: Arrays, h: np.ndarray, g: np.ndarray, doc: np.ndarray, place: np.ndarray):
        """Candidate windows (starts in the chunk) of documents that are not whole copies, their names, and the copies."""
        size = np.bincount(doc, minlength=len(place))
        a, b = document_names(h, g, doc, len(place))
        copy = arrays.copies(a, b, place) & (size >= window)
        s = parse(h, doc)
        at = candidates(s, arrays.shared(s.name), doc, window)
        at = at[~copy[doc[at]]]
        name, check = window_names(h, g, window)
        first = np.cumsum(size) - size
        return copy, at, name[at], check[at], doc[at], (at - first[doc[at]]).astype(np.uint32)

    def name_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(folder, n, first_pass)
        for batch in batches:
            for _, _, _, _, _, doc, h, g, place in read(batch):
                if not len(h):
                    continue
                _, _, name, check, number, start = look(arrays, h, g, doc, place)
                if not len(name):
                    continue
                order, first = _earliest([name, check, place[number], start])
                many = (np.diff(np.append(first, len(name))) > 1).astype(np.uint8)
                i = order[first]
                edges = C.cut(name[i], n)
                rows = []
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    j, m = i[edges[k] : edges[k + 1]], many[edges[k] : edges[k + 1]]
                    docs_here, ref = np.unique(place[number[j]], return_inverse=True)
                    rows.append((k, docs_here.tobytes(), _blob(name[j], check[j], ref.astype(np.uint32), start[j], m)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "docs", "a"]
                )

    def earliest(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["shard"].iloc[0])
        cells = [_cells(x, len(x) // 21, C.U, np.uint32, np.uint32, np.uint32, np.uint8) for x in pdf["a"]]
        name, check, start, many = (np.concatenate([c[i] for c in cells]) for i in (0, 1, 3, 4))
        doc = np.concatenate([np.frombuffer(d, np.int64)[c[2]] for d, c in zip(pdf["docs"], cells, strict=True)])
        order, first = _earliest([name, check, doc, start])
        size = np.diff(np.append(first, len(name)))
        twice = (size > 1) | (np.maximum.reduceat(many[order], first) > 0)
        first = order[first[twice]]
        for label, x in (("key", name), ("check", check), ("doc", doc), ("start", start)):
            C.put_array(f"{folder}/window{k}.{label}", x[first])
        return pd.DataFrame({"shard": [k], "n": [len(first)]})

    named = docs.mapInArrow(name_windows, "shard int, docs binary, a binary").groupBy("shard").applyInPandas(earliest, "shard int, n long")
    both_passes = first_pass | {f"window{r['shard']}" for r in named.collect()}

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(folder, n, both_passes)
        for batch in batches:
            for row, end, data, s, e, doc, h, g, place in read(batch):
                size = np.bincount(doc, minlength=end - row)
                gone = np.zeros(len(h), bool)
                if len(h):
                    copy, at, name, check, number, start = look(arrays, h, g, doc, place)
                    at = at[arrays.later(name, check, place[number], start)]
                    marks = np.bincount(at, minlength=len(h) + 1) - np.bincount(at + window, minlength=len(h) + 1)
                    gone = (np.cumsum(marks)[: len(h)] > 0) | copy[doc]
                keep = np.flatnonzero(~gone)
                length = e[keep] - s[keep] + 1
                flat = np.append(data, np.uint8(0x20))[spread(s[keep], length)]
                stop = np.cumsum(length)
                flat[stop - 1] = 0x20
                kept = np.bincount(doc[keep], minlength=end - row)
                last = np.cumsum(kept)
                edges = np.concatenate([[0], stop])[np.concatenate([[0], last])]
                raw = flat.tobytes()
                texts = [raw[a : max(a, b - 1)] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(size, pa.int64()), pa.array(size - kept, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["id", "n_words", "n_removed", "kept"],
                )

    return docs.mapInArrow(finish, f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", id_column)


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Rows (id, n_words, n_removed, kept_sha256), one for each row of ``remove_repeats``; a text without words keeps the
    digest of the empty text."""
    return found.select(id_column, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The digests in SQL for windows of 20 words.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN md5(array_to_string(w[i:i + 19], ' ')) END AS key FROM p),
f AS (SELECT doc_id, i, word, key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1 AS again FROM k),
c AS (SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
