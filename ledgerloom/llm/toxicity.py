"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features of a text are its words and their beginnings of four, five and six bytes (A-Z in lower case, punctuation
off), so compounds share the feature of their stem. Features that are far more frequent in toxic documents of a
bounded, labelled sample are kept; their weights are shared by all thresholds of the model
``P(grade <= k) = sigmoid(threshold_k - w . x)`` with x = log2(1 + count), fitted by full-batch Adam.

Grades are a column of the labels, if one is named. Where labels only say toxic or not, they are 0 for clean documents,
and 1 to 3 for toxic ones by thirds of how many occurrences they hold of features that the other half of the sample has
shown to be toxic; a document's own label and features have no say in the scale it is graded on. The expected severity
is the sum of the chances of exceeding each threshold; a document is toxic if its chance of grade 1 or more is at least ``cut``: by default the cut
of the best F-score of the sample, each half judged by features and weights learnt from the other half, which single
wrong labels hardly move, 0.5 at most. A wanted ``precision`` takes the least chance instead for which that share of the
rejected documents is labelled toxic. A document without a kept feature isn't rejected by the default cut.

Fitting uses at most ``max_rows`` documents of either label (those with the smallest hash of their id; of documents with
equal ids the smallest text), so what the driver holds is bounded whatever the input. Scoring is one narrow pass over
whole texts, in which every occurrence of a feature counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes that are no part of a word: ASCII other than letters and digits.
BETWEEN = np.ones(256, bool)
BETWEEN[0x80:] = False
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
STEMS = (4, 5, 6)


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def above_of(self, z: np.ndarray) -> np.ndarray:
        """The chances of exceeding each threshold, from products of weights and features."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -60, 60)))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all texts of a chunk and their documents."""
    low = C.LOWER[data]
    s, e, doc = C.words(low, offsets, BETWEEN)
    parts, docs = [C.word_hashes(low, s, e)], [doc]
    for k in STEMS:
        at = np.flatnonzero(e - s > k)
        parts.append(C.mix(C.word_hashes(low, s[at], s[at] + k) ^ C.U(k)))
        docs.append(doc[at])
    return np.concatenate(parts), np.concatenate(docs)


class Sparse:
    """Rows of few values, as the regression needs them: products with a vector from either side."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.rows, self.columns, self.values, self.shape = rows, columns, values, shape

    @classmethod
    def of(cls, x: np.ndarray) -> Sparse:
        rows, columns = np.nonzero(x)
        return cls(rows, columns, x[rows, columns].astype(np.float64), x.shape)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], minlength=self.shape[0])

    def sums(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * d[self.rows], minlength=self.shape[1])


def hits_of(kept: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts of a chunk: document, number of a kept feature and log2(1 + count), one row for each that occurs."""
    if not len(kept):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    h, doc = features(data, offsets)
    at = np.minimum(np.searchsorted(kept, h), len(kept) - 1)
    hit = kept[at] == h
    pair, count = np.unique(doc[hit] * len(kept) + at[hit], return_counts=True)
    return pair // len(kept), pair % len(kept), np.log2(1 + count)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 8000,
    least: int = 3,
    lift: float = 20.0,
    cut: float | None = None,
    precision: float | None = None,
    grade_column: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> Model:
    """Fit on a bounded sample. Labels that are null, or whose document is missing, are not used, null and empty texts
    have no features, of repeated labels the highest counts; without toxic or without clean examples, or on empty tables,
    the model finds nothing toxic."""
    toxic = F.col(label_column).cast("int")
    grade = F.col(grade_column).cast("int") if grade_column else F.when(toxic > 0, 1).otherwise(0)
    known = labels.where(toxic.isNotNull() & grade.isNotNull() & F.col(id_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.max(grade).alias("y"))
    order, half = F.xxhash64("id"), F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int")
    sample = known.where("y > 0").orderBy(order).limit(max_rows).unionByName(known.where("y <= 0").orderBy(order).limit(max_rows))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    chosen = rows.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    C.small_batches(docs.sparkSession)
    chosen = C.table(chosen.select("text", "y", half.alias("half")), "labelled-sample")
    cells = [(h, t) for h in (0, 1) for t in (False, True)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.empty(0, C.U)] for _ in cells]
        for batch in batches:
            cell = batch.column(2).to_numpy() * 2 + (batch.column(1).to_numpy() > 0)
            for row, _, data, offsets in C.text_chunks(batch, 0):
                h, doc = features(data, offsets)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                once = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)]
                h, mine = h[once], cell[row + doc[once]]
                for k in range(4):
                    held[k].append(h[mine == k])
        for k in range(4):
            keys, n = C.tally(np.concatenate(held[k]))
            columns = [keys.view(np.int64), *(n if i == k else np.zeros(len(n), np.int64) for i in range(4))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["feature", "n0", "n1", "n2", "n3"])

    totals = {(r["half"], r["t"]): r["n"] for r in chosen.groupBy("half", (F.col("y") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    totals = [totals.get(c, 0) for c in cells]
    nothing = Model(np.empty(0, C.U), np.empty(0), np.array([30.0]), 0.5)
    if not totals[0] + totals[2] or not totals[1] + totals[3]:
        return nothing

    def good(toxic, clean, n_toxic: int, n_clean: int):
        return (toxic >= least) & ((toxic + 0.5) / max(n_toxic, 1) / ((clean + 0.5) / max(n_clean, 1)) >= lift)

    n = [F.col(f"n{i}") for i in range(4)]
    sums = chosen.mapInArrow(count, "feature long, n0 long, n1 long, n2 long, n3 long").groupBy("feature").agg(*(F.sum(x).alias(f"n{i}") for i, x in enumerate(n)))
    chosen_by = [  # of all, of the first half, of the second half
        good(n[1] + n[3], n[0] + n[2], totals[1] + totals[3], totals[0] + totals[2]), good(n[1], n[0], *totals[1::-1]), good(n[3], n[2], *totals[:1:-1]),
    ]
    found = sums.select("feature", *(g.alias(f"g{i}") for i, g in enumerate(chosen_by))).where("g0 or g1 or g2").collect()  # of the sample
    keys = np.array([r["feature"] for r in found], np.int64).view(C.U)
    order = np.argsort(keys)
    union, by = keys[order], [np.array([r[f"g{i}"] for r in found], bool)[order] for i in range(3)]
    if not by[0].any():
        return nothing

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offsets in C.text_chunks(batch, 0):
                doc, feature, value = hits_of(union, data, offsets)
                edges = np.searchsorted(doc, np.arange(len(offsets)))
                out += [(feature[a:b].astype("<u4").tobytes(), value[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            hits = [pa.array([o[i] for o in out], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *hits], names=["y", "half", "f", "v"])

    rows = chosen.mapInArrow(extract, "y int, half int, f binary, v binary").collect()  # 2 * max_rows at most
    halves = [np.flatnonzero([r["half"] == h for r in rows]) for h in (0, 1)]
    toxic = np.array([r["y"] > 0 for r in rows])

    def matrix(of: np.ndarray, kept: np.ndarray) -> Sparse:
        """The chosen rows and the kept features only."""
        f, v = ([np.frombuffer(rows[i][c], t) for i in of] for c, t in (("f", "<u4"), ("v", "<f8")))
        place, number = np.repeat(np.arange(len(of)), [len(x) for x in f]), np.cumsum(kept) - 1
        column = np.concatenate([np.empty(0, "<u4"), *f]).astype(np.int64)
        some = kept[column]
        return Sparse(place[some], number[column[some]], np.concatenate([np.empty(0), *v])[some], (len(of), int(kept.sum())))

    y = np.array([r["y"] for r in rows])
    if not grade_column:
        amount = np.zeros(len(rows))
        for mine, kept in ((halves[0], by[2]), (halves[1], by[1])):
            x = matrix(mine, kept)
            amount[mine] = Sparse(x.rows, x.columns, np.exp2(x.values) - 1, x.shape).times(np.ones(x.shape[1]))
        y[toxic] = 1 + np.searchsorted(np.quantile(amount[toxic], [1 / 3, 2 / 3]), amount[toxic], side="left")

    def fitted(of: np.ndarray, kept: np.ndarray) -> Model:
        weights, thresholds = ordinal(matrix(of, kept), np.unique(y[of], return_inverse=True)[1])
        return Model(union[kept], weights, thresholds, 0.5 if cut is None else cut)

    model = fitted(np.arange(len(rows)), by[0])
    if cut is None:
        chance = np.zeros(len(rows))
        if min(totals) and by[1].any() and by[2].any():  # each half is judged by what the other one taught
            for mine, other, kept in ((halves[0], halves[1], by[2]), (halves[1], halves[0], by[1])):
                taught = fitted(other, kept)
                chance[mine] = taught.above_of(matrix(mine, kept).times(taught.weights))[:, 0]
        else:
            chance = model.above_of(matrix(np.arange(len(rows)), by[0]).times(model.weights))[:, 0]
        model.cut = cut_of(chance, toxic, float(model.above_of(np.zeros(1))[0, 0]), precision)
    return model


def cut_of(chance: np.ndarray, toxic: np.ndarray, plain: float, precision: float | None = None) -> float:
    """The chance from which documents are rejected; ``plain`` is the chance of one without features."""
    order = np.argsort(-chance, kind="stable")
    falling, hits, rejected = chance[order], np.cumsum(toxic[order]), np.arange(1, len(chance) + 1)
    last = np.append(falling[1:] < falling[:-1], True)  # equal chances are rejected together
    if precision is None:
        able = np.flatnonzero(last & (falling > plain))
        score = hits[able] * 2 / (rejected[able] + toxic.sum())
        good = able[np.flatnonzero(score == score.max(initial=0))[-1:]]
    else:
        good = np.flatnonzero(last & (hits / rejected >= precision))
    if not len(good):
        return 0.5 if precision is not None or plain < 0.5 else 1.0
    below = falling[good[-1] + 1] if good[-1] + 1 < len(chance) else 0.0
    cut = float((falling[good[-1]] + below) / 2)
    if precision is not None:
        return cut
    return min(cut, 0.5) if plain < 0.5 else max(cut, float(np.nextafter(plain, 2)))


def ordinal(x: Sparse | np.ndarray, y: np.ndarray, steps: int = 500, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds of the cumulative-link model, by Adam on the mean negative log likelihood."""
    x = x if isinstance(x, Sparse) else Sparse.of(x)
    top = int(y.max())
    share = np.array([(y <= k).mean() for k in range(top)])
    theta = np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    p = np.concatenate([np.zeros(x.shape[1]), theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])  # gaps as logs
    m, v, d = np.zeros_like(p), np.zeros_like(p), x.shape[1]
    rows = np.arange(len(y))
    for step in range(1, steps + 1):
        gaps = np.exp(p[d + 1 :])
        theta = p[d] + np.concatenate([[0], np.cumsum(gaps)])
        below = 1 / (1 + np.exp(np.clip(x.times(p[:d])[:, None] - theta[None, :], -60, 60)))
        edge = np.concatenate([np.zeros((len(y), 1)), below, np.ones((len(y), 1))], axis=1)
        slope = edge * (1 - edge)
        chance = np.maximum(edge[rows, y + 1] - edge[rows, y], 1e-12)
        up, down = slope[rows, y + 1] / chance, slope[rows, y] / chance  # d log chance / d upper, -d / d lower threshold
        dz = (up - down) / len(y)  # gradient of the loss by w . x
        dtheta = np.bincount(y, -up, minlength=top + 1)[:top] + np.bincount(y, down, minlength=top + 1)[1:]
        dtheta = dtheta / len(y)
        tail = np.cumsum(dtheta[::-1])[::-1]
        g = np.concatenate([x.sums(dz) + ridge * p[:d], tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:d], p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1 :]))])


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """The rows without their last column, the text, and then (expected_severity, grade, p_toxic, toxic); columns are
    named by number, so that no name clashes."""
    kinds = [f.dataType.simpleString() for f in rows.schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in C.text_chunks(batch, batch.num_columns - 1):
                doc, feature, value = hits_of(model.features, data, offsets)
                above = model.above_of(np.bincount(doc, value * model.weights[feature], minlength=end - row))
                chance = np.concatenate([1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]], axis=1)
                columns = [
                    *(batch.column(i).slice(row, end - row) for i in range(len(kinds))),
                    pa.array(above.sum(axis=1)), pa.array(chance.argmax(axis=1), pa.int32()), pa.array(above[:, 0]), pa.array(above[:, 0] >= model.cut),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    C.small_batches(rows.sparkSession)
    fields = ", ".join(f"c{i} {k}" for i, k in enumerate([*kinds, "double", "int", "double", "boolean"]))
    return rows.toDF(*[f"c{i}" for i in range(len(kinds) + 1)]).mapInArrow(run, fields)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, expected_severity, grade, p_toxic, toxic).

    Null and empty texts hold no features, long texts are read whole. Rows with equal or null ids are scored one by one.
    An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return _scored(rows, model).toDF(id_column, "expected_severity", "grade", "p_toxic", "toxic")


def drop_toxic(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """Documents that the model doesn't reject, with all their columns, whatever they are called."""
    n = len(docs.columns)
    rows = docs.toDF(*[f"c{i}" for i in range(n)])
    rows = rows.select("*", F.col(f"c{docs.columns.index(text_column)}").cast("string").alias("text"))
    return _scored(rows, model).where(~F.col(f"c{n + 3}")).select(*[f"c{i}" for i in range(n)]).toDF(*docs.columns)
