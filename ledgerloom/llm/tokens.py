"""Token ids of whole texts, each distinct word tokenized once for the whole corpus.

The public word-level vocabulary drops white space before it splits, so a text's ids are the ids of its words
``[^\\x20\\x09-\\x0D]+`` one after the other. One narrow pass names every task's distinct words; they meet by ranges
of their 64-bit hash, are tokenized once and stored as sorted hash arrays in the shared folder; a second narrow pass
maps the arrays and gathers ids. Words whose hashes collide are left out of the arrays and tokenized where they occur.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

NAME = "word_bpe_49k.json"


def tokenizer_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(NAME)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_words(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and where each word's begin (one more than there are words)."""
    ids: list[np.ndarray] = []
    sizes = np.zeros(len(words), dtype=np.int64)
    for i in range(0, len(words), 512):
        e = tokenizer.encode(words[i : i + 512], is_pretokenized=True, add_special_tokens=False)
        ids.append(np.asarray(e.ids, dtype=np.uint32))
        if e.ids:
            sizes[i : i + 512] += np.bincount(np.asarray(e.word_ids, dtype=np.int64), minlength=len(words[i : i + 512]))
    return np.concatenate([*ids, np.empty(0, np.uint32)]), np.concatenate([[0], np.cumsum(sizes)])


def vocabulary(docs: DataFrame, path: str, text_column: str = "text") -> tuple[str, int, frozenset[int]]:
    """Tokenize every distinct word of a corpus into sorted arrays; gives their folder, the number of shards, and which
    shards hold words."""
    n, folder = C.shards(docs), C.shared_folder(docs.sparkSession, "words")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(0, C.U)
        for batch in batches:
            for _, _, data, offsets in C.text_chunks(batch, "text"):
                s, e, _ = C.words(data, offsets)
                h, first, _ = C.distinct(C.word_hashes(data, s, e))
                if len(seen):
                    at = np.minimum(np.searchsorted(seen, h), len(seen) - 1)
                    new = seen[at] != h
                    h, first = h[new], first[new]
                seen = np.sort(np.concatenate([seen, h]))
                edges, raw = C.cut(h, n), data.tobytes()
                found = [raw[a:b] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
                full = [k for k in range(n) if edges[k] < edges[k + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([h[edges[k] : edges[k + 1]].tobytes() for k in full], pa.binary()),
                        pa.array([b"\n".join(found[edges[k] : edges[k + 1]]) for k in full], pa.binary()),
                    ],
                    names=["shard", "hashes", "words"],
                )
        C.give_back()

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        h = np.concatenate([np.frombuffer(x, C.U) for x in pdf["hashes"]])
        found = [w for x in pdf["words"] for w in bytes(x).split(b"\n")]
        order = np.argsort(h, kind="stable")
        h = h[order]
        words: list[bytes] = []
        keep: list[int] = []
        mixed: set[int] = set()
        for i, at in enumerate(order.tolist()):
            if keep and h[keep[-1]] == h[i]:
                if words[-1] != found[at]:
                    mixed.add(len(words) - 1)
            else:
                keep.append(i)
                words.append(found[at])
        kept = [i for i in range(len(words)) if i not in mixed]
        ids, starts = encode_words(load(path), [words[i].decode("utf-8", "replace") for i in kept])
        C.put_array(f"{folder}/{shard}.hash", h[np.array(keep, dtype=np.int64)[kept]])
        C.put_array(f"{folder}/{shard}.start", starts.astype(np.uint32))
        C.put_array(f"{folder}/{shard}.ids", ids)
        out = pd.DataFrame({"shard": [shard], "n": [len(kept)]})
        del pdf, h, found, order, words, keep, kept, ids, starts
        C.give_back()
        return out

    rows = docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(name, "shard int, hashes binary, words binary")
    stored = rows.groupBy("shard").applyInPandas(store, "shard int, n long").select("shard").collect()  # one row per shard
    return folder, n, frozenset(r["shard"] for r in stored)


class Words:
    """Maps the arrays of ``vocabulary`` and encodes chunks of text; made once per task."""

    def __init__(self, folder: str, n: int, stored: frozenset[int], path: str):
        self.folder, self.n, self.stored, self.path = folder, n, stored, path
        self.arrays: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.tokenizer = None

    def _shard(self, k: int):
        if k not in self.arrays:
            if k in self.stored:  # a missing file of these is an error
                self.arrays[k] = (
                    C.get_array(f"{self.folder}/{k}.hash", C.U),
                    C.get_array(f"{self.folder}/{k}.start", np.uint32),
                    C.get_array(f"{self.folder}/{k}.ids", np.uint32),
                )
            else:  # a range of hashes without words
                self.arrays[k] = (np.empty(0, C.U), np.zeros(1, np.uint32), np.empty(0, np.uint32))
        return self.arrays[k]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk one after the other, and where each text's begin."""
        s, e, doc = C.words(data, offsets)
        h, first, inverse = C.distinct(C.word_hashes(data, s, e))
        sizes = np.zeros(len(h), dtype=np.int64)
        pools: list[np.ndarray] = []
        edges, missing = C.cut(h, self.n), []
        for k in range(self.n):
            mine = h[edges[k] : edges[k + 1]]
            if not len(mine):
                continue
            keys, starts, ids = self._shard(k)
            at = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
            hit = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
            a = np.where(hit, starts[at], 0).astype(np.int64)
            b = np.where(hit, starts[np.minimum(at + 1, len(starts) - 1)], 0).astype(np.int64)
            sizes[edges[k] : edges[k + 1]] = b - a
            pools.append(ids[spread(a, b - a)])
            missing += (np.flatnonzero(~hit) + edges[k]).tolist()
        begin = np.concatenate([[0], np.cumsum(sizes)])
        pool = np.concatenate([*pools, np.empty(0, np.uint32)])
        if missing:
            self.tokenizer = self.tokenizer or load(self.path)
            raw = [data[s[first[i]] : e[first[i]]].tobytes().decode("utf-8", "replace") for i in missing]
            more, at = encode_words(self.tokenizer, raw)
            begin, sizes = begin[:-1], sizes.copy()
            begin[missing], sizes[missing] = len(pool) + at[:-1], np.diff(at)
            pool = np.concatenate([pool, more])
        count = sizes[inverse]
        ids = pool[spread(begin[inverse], count)]
        per_doc = np.bincount(doc, weights=count, minlength=len(offsets) - 1).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_doc)])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... of sizes[i] items each, one after the other."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)
