"""The pipeline's near-duplicate stage against all pairs of documents."""

import random
from fractions import Fraction

import numpy as np
import pytest

from ledgerloom.llm import setjoin, simhash
from ledgerloom.llm.common import mix

from .helpers import documents, lower, roots, texts, words


def shingle_set(text):
    w = words(lower(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain(values, bound=0.8):
    sets = {i: shingle_set(t) for i, t in enumerate(values)}
    near = [(i, j) for i in sets for j in sets if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= bound * len(sets[i] | sets[j]))]
    return roots(near, sets), len(near)


def near_copies():
    """Near copies at similarities about 0.8, most of them further apart than three bits of a fingerprint."""
    r = random.Random(11)
    out = texts(60)
    for size in (12, 40, 60, 150, 400):
        for _ in range(6):
            w = [f"n{r.randrange(3000)}" for _ in range(size)]
            out.append(" ".join(w))
            for changes in (1, 2, 4, 8):
                v = list(w)
                for k in range(changes):
                    v[(k * 37 + changes) % size] = "changed"
                out.append(" ".join(v))
    return out


@pytest.mark.parametrize("sample, block", [(32, 256), (1, 3)])
def test_links_are_all_pairs_of_the_similarity(spark, sample, block, monkeypatch):
    values = near_copies()
    want, pairs = plain(values)
    assert pairs > 50
    whole = setjoin.links
    monkeypatch.setattr(setjoin, "SAMPLE", sample)
    monkeypatch.setattr(setjoin, "links", lambda *a: whole(*a, block))
    got = {r["doc_id"]: r["component_id"] for r in setjoin.near_duplicates(documents(spark, values)).collect()}
    assert got == want


def test_pipeline_stage_drops_near_copies(spark):
    import corpus_pipeline as p

    values = near_copies()
    want = plain(values)[0]
    kept = p.drop_near_duplicates(spark, documents(spark, values), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.keep_one(documents(spark, values), 5, 3).count() > len(set(want.values()))
    assert p.drop_near_duplicates(spark, documents(spark, values).limit(0), "").count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert [r["doc_id"] for r in p.drop_near_duplicates(spark, nulls, "").orderBy("doc_id").collect()] == [None, None, 3]


def test_pipeline_stage_uses_fingerprints(spark):
    """documents that only Operator 5 links are near copies too, and links of both kinds go on from one another."""
    import corpus_pipeline as p

    base = [f"w{i}" for i in range(31)] * 20  # no bit is near half: few more words change none
    more = base + [f"x{i}" for i in range(10)]
    far = [w for w in more]
    far[-3:] = ["y0"]
    values = ["some other text that is on its own", " ".join(base), " ".join(more), " ".join(far)]
    docs = documents(spark, values)
    bits = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    sets = plain(values)[0]
    assert bits[2] == 1 and sets[2] == 2
    want = roots([(i, c) for found in (bits, sets) for i, c in found.items()], set(range(4)))
    assert sorted(r["doc_id"] for r in p.drop_near_duplicates(spark, docs, "").collect()) == sorted(set(want.values())) == [0, 1]


@pytest.fixture
def tables(monkeypatch):
    """Rows of each table that is written, and its plan, by name."""
    from ledgerloom.llm import common

    seen, write = {}, common.table

    def table(df, name, *a):
        out = write(df, name, *a)
        seen.setdefault(name, []).append((out.count(), df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(common, "table", table)
    return seen


def test_long_texts_that_share_a_passage_are_no_candidates(spark, tables):
    """Pipeline on 0.51 GB: long texts that have little in common took the disk, as few buckets do not tell them apart."""
    r = random.Random(5)
    passage = [f"p{i}" for i in range(300)]
    values = [" ".join([f"w{r.randrange(10**9)}" for _ in range(6000)] + passage) for _ in range(8)]
    copy = values[0].split(" ")
    copy[3000:3400] = [f"x{i}" for i in range(400)]
    values.append(" ".join(copy))
    want, pairs = plain(values)
    assert pairs == 1 and want[8] == 0
    got = {r["doc_id"]: r["component_id"] for r in setjoin.near_duplicates(documents(spark, values)).collect()}
    assert got == want
    assert [n for n, _ in tables["shingle-candidates"]] == [1, 0]


def test_texts_are_not_shuffled(spark, tables):
    """Pipeline on 0.51 GB: every text was shuffled, twice, to find those that are compared."""
    values = near_copies()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the ids are too many for a broadcast
    try:
        got = {r["doc_id"]: r["component_id"] for r in setjoin.near_duplicates(documents(spark, values)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == plain(values)[0]
    plans = [plan for name in ("links-of-leaders", "links-across") for _, plan in tables[name]]
    assert len(plans) == 2 and not any("SortMergeJoin" in plan for plan in plans)


def test_bucket_counts_never_rule_out_a_link():
    """Sets of either side of a size at which the buckets double, and a bucket that is full."""
    r = random.Random(7)
    common_part = [r.randrange(1 << 60) for _ in range(1000)]
    full = np.arange(100_000, dtype=np.uint64)
    full = full[mix(full) % np.uint64(256) == 0][:330].tolist()
    sets = [common_part + [r.randrange(1 << 60) for _ in range(k)] for k in (0, 20, 24, 25, 100, 230)] + [full[:270], full]
    sets = [np.unique(np.array(x, np.uint64)) for x in sets]
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    counts, begin = setjoin.sketches(np.concatenate(sets), at)
    held = (np.diff(at), begin, counts)
    assert counts.max() == 255 and set(np.diff(begin).tolist()) == {setjoin.BUCKETS, 2 * setjoin.BUCKETS}
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(sets)) for j in range(len(sets))], strict=True))
    bound = Fraction(4, 5)
    true = np.array([setjoin.linked(sets[i], sets[j], bound) for i, j in zip(a, b, strict=True)])
    near = setjoin.close(a, b, held, bound)
    assert near[true].all() and true.sum() > len(sets) and not near[(a < 6) & (b >= 6)].any()
