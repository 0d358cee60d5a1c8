"""Documents whose sets of word shingles have a Jaccard similarity of a bound or more, by an exact prefix filter.

1. A sample of documents tells which shingles are frequent. A shingle's token is 60 bits of its hash below a class of
   frequency, so tokens in order begin with rare ones. The sample only changes the speed, never the links.
2. Equal sets share a digest. Of a set with n tokens the first n - ceil(bound * n) + 1 meet by token: two sets of the
   bound or more share one of these. Pairs whose sizes, or whose places of the token, rule the bound out are dropped.
   This is done twice: first every set meets only a few leaders of each token, which joins large groups of near copies
   by pairs in proportion to their size; then all pairs of sets that are not in one component yet are looked at.
   Tokens are dealt to shards once; both rounds read what was kept of them, the tokens of two sets or more.
3. Candidates whose counts of tokens in buckets already differ too much are dropped before they leave their token: those
   differences never exceed the sets'. A set has a bucket for each 4 to 8 tokens, ``BUCKETS`` at least, so that long sets
   are told apart as well as short ones. The others meet again by connected component and pair of blocks of it, each set
   only where a candidate of it is, and are compared token by token. Only a spanning forest of true links goes on to the
   distributed connected components.

Sizes, bucket counts, components and places are sorted arrays in the shared folder, which tasks memory-map, so no text is
shuffled. Nothing is capped. Sets and digests are compared by hashes of 60 and 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .tokens import spread

#: One in so many documents is sampled for frequent shingles, of which so many are kept at most.
SAMPLE, FREQUENT = 32, 100_000
#: Buckets of a set of 8 * BUCKETS tokens or fewer; twice as many each time that the set may be twice as large.
BUCKETS = 128
#: Leaders of a token that its sets are compared with first.
LEADERS = 4
#: Sizes of sets, where their bucket counts begin, and those counts.
Sketches = tuple[np.ndarray, np.ndarray, np.ndarray]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """60-bit hashes of all shingles of a chunk's texts, A-Z in lower case, and their documents; a short text has one."""
    low = C.LOWER[data]
    s, e, doc = C.words(low, offsets)
    docs = len(offsets) - 1
    per_doc = np.bincount(doc, minlength=docs)
    first = np.cumsum(per_doc) - per_doc
    count = np.where(per_doc > 0, np.maximum(per_doc - size + 1, 1), 0)
    owner = np.repeat(np.arange(docs), count)
    begin, stop = spread(first, count), (first + per_doc)[owner]
    w = C.word_hashes(low, s, e) if len(s) else np.empty(0, C.U)
    h = np.zeros(len(begin), C.U)
    for k in range(size):
        h = C.mix(h + C.U(k + 1) + np.where(begin + k < stop, w[np.minimum(begin + k, stop - 1)], C.U(0)))
    return h >> C.U(4), owner


def sets_of(data: np.ndarray, offsets: np.ndarray, size: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct tokens of each text of a chunk one after the other, where each text's begin, and digests."""
    h, owner = shingle_hashes(data, offsets, size)
    if len(frequent):
        plain = frequent & C.U((1 << 60) - 1)
        at = np.minimum(np.searchsorted(plain, h), len(plain) - 1)
        h = np.where(plain[at] == h, frequent[at], h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])[: len(h)]
    h, owner = h[keep], owner[keep]
    at = np.searchsorted(owner, np.arange(len(offsets)))
    sums = np.concatenate([np.zeros(1, C.U), np.cumsum(C.mix(h + C.U(1)), dtype=C.U)])
    return h, at, C.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(C.U))


def levels(n: np.ndarray) -> np.ndarray:
    """How often ``BUCKETS`` is doubled for sets of n tokens."""
    return np.searchsorted(8 * BUCKETS << np.arange(40), n).astype(np.int64)


def sketches(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set how many tokens (255 at most) fall in each of its buckets, and where each set's counts begin."""
    n = np.diff(at)
    width = BUCKETS << levels(n)
    begin = np.concatenate([[0], np.cumsum(width)])
    cell = np.repeat(begin[:-1], n) + (C.mix(h) & np.repeat(width - 1, n).astype(C.U)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=begin[-1]), 255).astype(np.uint8), begin


def prefix(n: np.ndarray, bound: Fraction) -> np.ndarray:
    """How many tokens of a set of n must meet others."""
    p, q = bound.numerator, bound.denominator
    return np.where(n > 0, n + (-p * n) // q + 1, 0)


def frequent_tokens(docs: DataFrame, size: int, id_column: str) -> np.ndarray:
    """Tokens, with their class, of shingles in several of the sampled documents; sorted by hash."""
    n = C.shards(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in C.text_chunks(batch, 0):
                h = sets_of(data, offsets, size, np.empty(0, C.U))[0]
                order = np.argsort(h % C.U(n), kind="stable")
                edges = np.searchsorted((h % C.U(n))[order], np.arange(n + 1))
                full = [k for k in range(n) if edges[k] < edges[k + 1]]
                blobs = [h[order[edges[k] : edges[k + 1]]].tobytes() for k in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "tokens"])
        C.give_back()

    def most(pdf: pd.DataFrame) -> pd.DataFrame:
        h, times = C.tally(np.concatenate([np.frombuffer(x, C.U) for x in pdf["tokens"]]))
        top = np.argsort(-times, kind="stable")[: FREQUENT // n + 1]
        top = top[times[top] > 1]
        rank = np.minimum(np.log2(times[top]).astype(np.int64), 15).astype(C.U)
        return pd.DataFrame({"tokens": [(h[top] | rank << C.U(60)).tobytes()]})

    rows = docs.where(F.pmod(F.xxhash64(id_column), F.lit(SAMPLE)) == 0).select("text").mapInArrow(count, "shard int, tokens binary")
    found = rows.groupBy("shard").applyInPandas(most, "tokens binary").collect()
    tokens = np.concatenate([np.empty(0, C.U), *(np.frombuffer(r["tokens"], C.U) for r in found)])
    return tokens[np.argsort(tokens & C.U((1 << 60) - 1))]


def distinct_pairs(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])[: len(pairs)]]


def _met(token: np.ndarray, digest: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows ordered by token, size and digest, each digest once a token."""
    order = np.lexsort((digest, n, token))
    token, digest, n, place = token[order], digest[order], n[order], place[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (digest[1:] != digest[:-1])])[: len(token)]
    return token[new], digest[new], n[new], place[new]


def _able(a: np.ndarray, b: np.ndarray, n: np.ndarray, place: np.ndarray, bound: Fraction) -> np.ndarray:
    """Whether sizes, and the places of the shared token, allow the bound: at a pair's first common token nothing before
    it is shared, so at most it and what follows."""
    p, q = bound.numerator, bound.denominator
    shared = np.minimum(n[a] - place[a], n[b] - place[b])
    return (q * np.minimum(n[a], n[b]) >= p * np.maximum(n[a], n[b])) & ((p + q) * shared >= p * (n[a] + n[b]))


def led(token: np.ndarray, digest: np.ndarray, n: np.ndarray, place: np.ndarray, bound: Fraction, leaders: int, known: Known) -> np.ndarray:
    """Distinct pairs of every set with a few leaders of those that share its token, where the bucket counts allow the
    bound. Leaders are those of least hash, so a group of near copies has the same ones at most of its tokens: pairs grow
    with its size, not with the square of it. Rows are ordered as ``_met`` does."""
    if not len(token):
        return np.empty((0, 2), C.U)
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(first, len(token)))
    here, out = np.arange(len(token)), [np.empty((0, 2), C.U)]
    for k in range(leaders):
        key = C.mix(digest ^ C.U(0x9E37 + k))
        best = np.flatnonzero(key == np.repeat(np.minimum.reduceat(key, first), size))
        leader = np.repeat(best[np.searchsorted(best, first)], size)
        good = (leader != here) & _able(here, leader, n, place, bound)
        x, y = digest[here[good]], digest[leader[good]]
        out.append(distinct_pairs(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)))
    pairs = distinct_pairs(np.concatenate(out))
    which, held = known.counts(pairs.reshape(-1))
    return pairs[close(which[::2], which[1::2], held, bound)]


def folded(held: Sketches, sets: np.ndarray, level: int) -> np.ndarray:
    """The bucket counts of sets in ``BUCKETS << level`` buckets; buckets that have the same low bits are added up."""
    n, begin, counts = held
    width, out, more = BUCKETS << level, np.empty((len(sets), BUCKETS << level), np.uint8), levels(n[sets]) - level
    for d in np.unique(more).tolist():
        mine = np.flatnonzero(more == d)
        cells = counts[begin[sets[mine]][:, None] + np.arange(width << d)]
        out[mine] = np.minimum(cells.reshape(len(mine), 1 << d, width).sum(axis=1, dtype=np.int32), 255) if d else cells
    return out


def close(a: np.ndarray, b: np.ndarray, held: Sketches, bound: Fraction) -> np.ndarray:
    """Whether the bucket counts of pairs of sets, by their numbers in ``held``, allow the bound."""
    p, q = bound.numerator, bound.denominator
    n, out = held[0], np.zeros(len(a), bool)
    low = levels(np.minimum(n[a], n[b]))
    for level in np.unique(low).tolist():
        mine, step = np.flatnonzero(low == level), max(1, (1 << 20) // (BUCKETS << level))
        for part in (mine[i : i + step] for i in range(0, len(mine), step)):
            x, y = a[part], b[part]
            differ = np.abs(folded(held, x, level).astype(np.int16) - folded(held, y, level)).sum(axis=1, dtype=np.int64)
            out[part] = (p + q) * differ <= (q - p) * (n[x] + n[y])
    return out


def meetings(token: np.ndarray, digest: np.ndarray, n: np.ndarray, place: np.ndarray, bound: Fraction, known: Known) -> np.ndarray:
    """Distinct pairs of digests of different components that share a token where sizes, places and bucket counts allow
    the bound. Rows are ordered as ``_met`` does."""
    root = known.roots(digest)
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, np.int64)
    if len(token):  # a token whose sets are all in one component has nothing to add
        mixed = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
        keep = np.repeat(mixed, np.diff(np.append(first, len(token))))
        token, digest, n, place, root = token[keep], digest[keep], n[keep], place[keep], root[keep]
    which, held = known.counts(digest)
    p, q = bound.numerator, bound.denominator
    out, kept, here, d = [np.empty((0, 2), C.U)], 0, np.arange(len(token)), 1
    while True:
        here = here[here + d < len(token)]
        # n grows within a token: what is too large for a set stays so
        here = here[(token[here] == token[here + d]) & (q * n[here] >= p * n[here + d])]
        if not len(here):
            return distinct_pairs(np.concatenate(out))
        a, b = here, here + d
        good = _able(a, b, n, place, bound) & (root[a] != root[b])
        a, b = a[good], b[good]
        good = close(which[a], which[b], held, bound)
        a, b = digest[a[good]], digest[b[good]]
        out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        kept, d = kept + len(a), d + 1
        if kept > 4_000_000:
            out = [distinct_pairs(np.concatenate(out))]
            kept = 0


class Lists:
    """Rows (k, v) of longs as sorted arrays of the shared folder, to find the values of a key."""

    def __init__(self, rows: DataFrame, name: str):
        self.n, self.folder = C.shards(rows), C.shared_folder(rows.sparkSession, name)
        n, folder = self.n, self.folder

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k, v = (batch.column(i).to_numpy().view(C.U) for i in (0, 1))
                shard = C.shard_of(C.mix(k), n)
                full = np.unique(shard)
                blobs = [[x[shard == i].tobytes() for i in full] for x in (k, v)]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array(x, pa.binary()) for x in blobs)], names=["shard", "k", "v"])

        def store(pdf: pd.DataFrame) -> pd.DataFrame:
            i = int(pdf["shard"].iloc[0])
            k, v = (np.concatenate([np.frombuffer(x, C.U) for x in pdf[c]]) for c in ("k", "v"))
            order = np.lexsort((v, k))
            C.put_array(f"{folder}/{i}.k", k[order])
            C.put_array(f"{folder}/{i}.v", v[order])
            return pd.DataFrame({"shard": [i]})

        packed = rows.mapInArrow(pack, "shard int, k binary, v binary").groupBy("shard")
        self.full = {r["shard"] for r in packed.applyInPandas(store, "shard int").collect()}  # one row per shard

    def find(self, keys: np.ndarray, maps: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """How many values each key has, and the values one after the other. ``maps`` keeps what a task has opened."""
        shard = C.shard_of(C.mix(keys), self.n)
        count, parts = np.zeros(len(keys), np.int64), []
        for i in sorted(self.full & set(shard.tolist())):
            if i not in maps:
                maps[i] = C.get_array(f"{self.folder}/{i}.k", C.U), C.get_array(f"{self.folder}/{i}.v", C.U)
            mine, (k, v) = np.flatnonzero(shard == i), maps[i]
            at = np.searchsorted(k, keys[mine])
            count[mine] = np.searchsorted(k, keys[mine], side="right") - at
            parts.append((mine, at, v))
        values, begin = np.empty(int(count.sum()), C.U), np.cumsum(count) - count
        for mine, at, v in parts:
            values[spread(begin[mine], count[mine])] = v[spread(at, count[mine])]
        return count, values


class Known:
    """The size and the bucket counts of each digest, and the component that it is known to be in, as sorted arrays of the
    shared folder."""

    def __init__(self, signed: DataFrame):
        """From rows (digest, n, sketch); equal digests have equal ones."""
        self.n, self.folder = C.shards(signed), C.shared_folder(signed.sparkSession, "known-sets")
        self.groups: Lists | None = None
        n, folder = self.n, self.folder

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, size = batch.column(0).to_numpy().view(C.U), batch.column(1).to_numpy()
                shard, once = C.shard_of(C.mix(ids), n), np.unique(ids, return_index=True)[1]
                rows = [once[shard[once] == k] for k in range(n)]
                full = [k for k in range(n) if len(rows[k])]
                counts = [b"".join(batch.column(2).take(pa.array(rows[k])).to_pylist()) for k in full]
                blobs = [[x[rows[k]].tobytes() for k in full] for x in (ids, size)]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in (*blobs, counts))], names=["shard", "id", "n", "counts"])

        def store(pdf: pd.DataFrame) -> pd.DataFrame:
            k = int(pdf["shard"].iloc[0])
            ids, size = (np.concatenate([np.frombuffer(x, kind) for x in pdf[c]]) for c, kind in (("id", C.U), ("n", np.int64)))
            counts = np.frombuffer(b"".join(pdf["counts"]), np.uint8)
            width = BUCKETS << levels(size)
            ids, once = np.unique(ids, return_index=True)
            C.put_array(f"{folder}/{k}.id", ids)
            C.put_array(f"{folder}/{k}.n", size[once])
            C.put_array(f"{folder}/{k}.counts", counts[spread((np.cumsum(width) - width)[once], width[once])])
            return pd.DataFrame({"shard": [k]})

        packed = signed.select("digest", "n", "sketch").mapInArrow(pack, "shard int, id binary, n binary, counts binary")
        packed.groupBy("shard").applyInPandas(store, "shard int").collect()  # one row per shard

    def roots(self, digest: np.ndarray) -> np.ndarray:
        """The component of each digest; one that has no row in ``groups`` is its own."""
        keys, _, which = C.distinct(digest)
        count, found = self.groups.find(keys, {})
        root = keys.copy()
        root[count > 0] = found
        return root[which]

    def counts(self, digest: np.ndarray) -> tuple[np.ndarray, Sketches]:
        """The number of each digest among the distinct ones, and their sizes, where their bucket counts begin and those
        counts. Every digest has been stored."""
        keys, _, which = C.distinct(digest)
        size, shard, places = np.empty(len(keys), np.int64), C.shard_of(C.mix(keys), self.n), []
        for k in np.unique(shard).tolist():
            mine, ids, n = np.flatnonzero(shard == k), C.get_array(f"{self.folder}/{k}.id", C.U), C.get_array(f"{self.folder}/{k}.n", np.int64)
            at = np.searchsorted(ids, keys[mine])
            if not np.array_equal(ids[np.minimum(at, len(ids) - 1)], keys[mine]):
                raise ValueError("a set is missing in the shared folder")
            width = BUCKETS << levels(n)
            size[mine] = n[at]
            places.append((k, mine, (np.cumsum(width) - width)[at]))
        width = BUCKETS << levels(size)
        begin = np.concatenate([[0], np.cumsum(width)])
        out = np.empty(begin[-1], np.uint8)
        for k, mine, at in places:
            out[spread(begin[mine], width[mine])] = C.get_array(f"{self.folder}/{k}.counts", np.uint8)[spread(at, width[mine])]
        return which, (size, begin, out)


def linked(a: np.ndarray, b: np.ndarray, bound: Fraction) -> bool:
    """Whether two sorted sets have the bound's similarity."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared * bound.denominator >= (len(both) - shared) * bound.numerator


class Tokens:
    """The tokens that sets meet by, dealt to shards and kept in the shared folder where two sets or more have one."""

    def __init__(self, docs: DataFrame, size: int, bound: Fraction, frequent: np.ndarray):
        self.bound, self.folder = bound, C.shared_folder(docs.sparkSession, "met-tokens")
        n_shards, folder = C.shards(docs), self.folder

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, data, offsets in C.text_chunks(batch, 0):
                    h, at, digest = sets_of(data, offsets, size, frequent)
                    n = np.diff(at)
                    take = prefix(n, bound)
                    _, once = np.unique(digest, return_index=True)
                    take = np.where(np.isin(np.arange(len(n)), once), take, 0)
                    place = spread(np.zeros(len(n), np.int64), take)
                    token, owner = h[spread(at[:-1], take)], np.repeat(np.arange(len(n)), take)
                    shard = (C.mix(token) % C.U(n_shards)).astype(np.int64)
                    order = np.argsort(shard, kind="stable")
                    edges = np.searchsorted(shard[order], np.arange(n_shards + 1))
                    cells = (token, digest[owner], n[owner].astype(np.int32), place.astype(np.int32))
                    full = [k for k in range(n_shards) if edges[k] < edges[k + 1]]
                    blobs = [[c[order[edges[k] : edges[k + 1]]].tobytes() for k in full] for c in cells]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["shard", "token", "digest", "n", "place"]
                    )
            C.give_back()

        def keep(pdf: pd.DataFrame) -> pd.DataFrame:
            k = int(pdf["shard"].iloc[0])
            token, digest = (np.concatenate([np.frombuffer(x, C.U) for x in pdf[c]]) for c in ("token", "digest"))
            n, place = (np.concatenate([np.frombuffer(x, np.int32) for x in pdf[c]]) for c in ("n", "place"))
            cells = _met(token, digest, n, place)
            same = cells[0][1:] == cells[0][:-1]
            shared = np.append(same, False) | np.append(False, same) if len(same) else np.zeros(len(cells[0]), bool)
            for name, x in zip(("token", "digest", "n", "place"), cells, strict=True):
                C.put_array(f"{folder}/{k}.{name}", x[shared])
            del token, digest, n, place, cells, same, shared
            C.give_back()
            return pd.DataFrame({"shard": [k]})

        rows = docs.select("text").mapInArrow(sign, "shard int, token binary, digest binary, n binary, place binary")
        self.full = sorted(r["shard"] for r in rows.groupBy("shard").applyInPandas(keep, "shard int").collect())  # one row per shard

    def read(self, k: int) -> list[np.ndarray]:
        kinds = {"token": C.U, "digest": C.U, "n": np.int32, "place": np.int32}
        cells = [C.get_array(f"{self.folder}/{k}.{name}", kind) for name, kind in kinds.items()]
        return [*cells[:2], *(x.astype(np.int64) for x in cells[2:])]


def candidates(spark: SparkSession, tokens: Tokens, known: Known) -> DataFrame:
    """Distinct pairs (a, b) of digests that may have the bound's similarity: every set with its tokens' leaders, or, once
    components are known, all pairs of different ones."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                cells = tokens.read(tokens.full[i])
                pairs = led(*cells, tokens.bound, LEADERS, known) if known.groups is None else meetings(*cells, tokens.bound, known)
                del cells
                pairs = pairs.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])
        C.give_back()

    n = len(tokens.full)
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(meet, "a long, b long").distinct()


def links(docs: DataFrame, signed: DataFrame, size: int, bound: Fraction, frequent: np.ndarray, block: int = 512) -> DataFrame:
    """Edges (a, b) between digests that span every group linked by the bound's similarity.

    ``docs`` has columns id and text, ``signed`` id, digest, size (n) and sketch. Sets are first compared with leaders;
    then all pairs that lie in different components after that.
    """
    known, tokens = Known(signed), Tokens(docs, size, bound, frequent)
    first = C.table(verified(docs, signed, candidates(docs.sparkSession, tokens, known), size, bound, frequent, block), "links-of-leaders")
    known.groups = Lists(C.components(first, "groups-of-leaders"), "known-components")
    rest = C.table(verified(docs, signed, candidates(docs.sparkSession, tokens, known), size, bound, frequent, block), "links-across")
    return first.unionByName(rest)


def verified(docs: DataFrame, signed: DataFrame, pairs: DataFrame, size: int, bound: Fraction, frequent: np.ndarray, block: int) -> DataFrame:
    """Of candidate pairs (a, b) a spanning forest of those that have the bound's similarity."""
    pairs = C.table(pairs, "shingle-candidates")
    groups = C.components(pairs, "candidate-groups")
    groups = groups.unionByName(groups.select(F.col("root").alias("id"), "root")).distinct()
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    nodes = groups.join(sizes, "root").select(F.col("id").alias("digest"), "root", "blocks")
    nodes = C.table(nodes.withColumn("mine", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")), "candidate-nodes")

    def key(mine: str, other: str) -> F.Column:
        return F.xxhash64("root", F.least(mine, other), F.greatest(mine, other)).alias("key")

    ends = [nodes.select(F.col("digest").alias(c), "root", F.col("mine").alias(f"m{c}")) for c in ("a", "b")]
    asked = C.table(pairs.join(ends[0], "a").join(ends[1].drop("root"), "b").select(key("ma", "mb"), "a", "b"), "candidate-pairs")
    places = asked.select("key", F.col("a").alias("digest")).unionByName(asked.select("key", F.col("b").alias("digest")))
    places = C.table(places.distinct(), "candidate-places")

    reps = signed.join(nodes, "digest", "left_semi").groupBy("digest").agg(F.min("id").alias("id"))
    wanted = Lists(places.join(reps, "digest").select(F.xxhash64("id").alias("k"), F.col("key").alias("v")), "candidate-ids")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, seen = {}, set()  # copies of a text are sent once
        for batch in batches:
            count, keys = wanted.find(batch.column(0).to_numpy().view(C.U), maps)
            mine = np.flatnonzero(count)
            begin = (np.cumsum(count) - count)[mine]
            for row, end, data, offsets in C.text_chunks(batch.take(pa.array(mine))) if len(mine) else ():
                h, at, digest = sets_of(data, offsets, size, frequent)
                for i, d in enumerate(digest.view(np.int64).tolist()):
                    of = keys[begin[row + i] : begin[row + i] + count[mine[row + i]]].view(np.int64)
                    of = [k for k in of.tolist() if (k, d) not in seen]
                    seen.update((k, d) for k in of)
                    blob, step = h[at[i] : at[i + 1]].tobytes(), max(1, C.CHUNK_BYTES // max(1, 8 * int(at[i + 1] - at[i])))
                    for part in (of[j : j + step] for j in range(0, len(of), step)):
                        cells = [pa.array(part, pa.int64()), pa.array([d] * len(part), pa.int64()), pa.array([blob] * len(part), pa.binary())]
                        yield pa.RecordBatch.from_arrays(cells, names=["key", "digest", "tokens"])
        C.give_back()

    held = docs.select(F.xxhash64("id").alias("k"), "text").mapInArrow(gather, "key long, digest long, tokens binary")

    def compare(ask: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        found = {d: np.frombuffer(t, C.U) for d, t in zip(sets["digest"], sets["tokens"], strict=True)}
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        out = []
        for a, b in zip(ask["a"].tolist(), ask["b"].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb and linked(found[a], found[b], bound):
                up[ra] = rb
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return asked.groupBy("key").cogroup(held.groupBy("key")).applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, component_id): the smallest id reachable by links of the similarity or more, itself included.

    Equal sets are linked, so null and empty texts are too. A null id is never the smallest unless a component has no
    other. Other columns are ignored.
    """
    bound = Fraction(similarity).limit_denominator(10_000)
    if not 0 < bound <= 1 or math.isnan(similarity):
        raise ValueError("similarity must be above 0 and at most 1")
    C.small_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    frequent = frequent_tokens(texts, shingle, "id")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in C.text_chunks(batch):
                h, at, d = sets_of(data, offsets, shingle, frequent)
                counts, begin = sketches(h, at)
                sketch = pa.array([counts[i:j].tobytes() for i, j in zip(begin[:-1], begin[1:], strict=True)], pa.binary())
                cells = [batch.column(0).slice(row, end - row), pa.array(d.view(np.int64)), pa.array(np.diff(at)), sketch]
                yield pa.RecordBatch.from_arrays(cells, names=["id", "digest", "n", "sketch"])
        C.give_back()

    signed = C.table(texts.mapInArrow(digest, f"id {kind}, digest long, n long, sketch binary"), "shingle-digests")
    reps = C.table(signed.groupBy("digest").agg(F.min("id").alias("rep")), "distinct-shingle-sets")
    joined = C.components(C.table(links(texts, signed, shingle, bound, frequent), "shingle-links"))
    rooted = reps.join(joined.select(F.col("id").alias("digest"), "root"), "digest", "left").select("digest", "rep", F.coalesce("root", "digest").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = rooted.join(lows, "root").select("digest", "component_id")
    return signed.join(classes, "digest").select(F.col("id").alias(id_column), "component_id")
