import collections
import math

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import common, kdtree, mixing, queries, signhash

from .helpers import documents, roots, texts

SF = "/root/testdata/sf0.001"


def vectors(n=300, d=8, seed=5):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n // 3, d))
    x = np.concatenate([base, base + r.standard_normal(base.shape) * 0.05, np.repeat(base[:1], n // 3, axis=0)])
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def table(spark, x, labels=None):
    rows = [(int(i), [float(c) for c in v], None if labels is None else labels[i], "k") for i, v in enumerate(x)]
    rows += [(9000, None, 1, "k"), (9001, [0.0] * x.shape[1], 1, "k"), (9002, [float("nan")] * x.shape[1], 1, "k"), (9003, [None, 1.0], 1, "k"), (9004, [], 1, "k"), (None, [1.0] * x.shape[1], 1, "k")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")


@pytest.mark.parametrize("shard_rows", [40, 8192])
def test_kdtree_is_exact(spark, shard_rows):
    x = vectors()
    rows = kdtree.top_k(table(spark, x), k=5, every=7, shard_rows=shard_rows).collect()
    z = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    found = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    for i in range(0, len(x), 7):
        s = {j: int(z[i] @ z[j]) for j in range(len(x)) if j != i} | {9001: 0}
        assert found[i] == sorted(s.items(), key=lambda p: (-p[1], p[0]))[:5]


def test_kdtree_edges(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (100, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in kdtree.top_k(few).collect()) == [(0, 1, 1), (0, 2, 100), (100, 1, 0), (100, 2, 1)]
    assert kdtree.top_k(few.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8192, 16])
def test_signhash(spark, block):
    x = vectors()
    labels = [i % 2 if i % 11 else None for i in range(len(x))]
    rows = {r["vec_id"]: r for r in signhash.near_duplicates(table(spark, x, labels), block=block).collect()}
    y = x.astype(np.float64)
    s = (y @ y.T) / np.sqrt(np.outer((y * y).sum(1), (y * y).sum(1))) >= 0.98
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] and labels[i] == labels[j] is not None]
    count = collections.Counter(i for p in pairs for i in p)
    root = roots(pairs, range(len(x)))
    assert all(rows[i]["n_links"] == count[i] and rows[i]["component_id"] == root[i] and rows[i]["kept"] == (root[i] == i) for i in range(len(x)))
    assert all(rows[i]["n_links"] == 0 and rows[i]["kept"] for i in range(9000, 9005)) and not rows[None]["kept"]
    assert signhash.near_duplicates(table(spark, x).limit(0)).count() == 0


def test_components(spark):
    r = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 600)]
    got = {x["id"]: x["root"] for x in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(pairs, {i for p in pairs for i in p})
    assert all(want[i] == got.get(i, i) for i in want)


@pytest.mark.parametrize("few", [8, 1 << 18])
def test_components_across_tasks(spark, monkeypatch, few):
    monkeypatch.setattr(common, "TASK_EDGES", few)
    r = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in r.integers(-300, 300, (260, 2))] + [(i + 1, i) for i in range(1000, 1040)] + [(-(2**63), 2**63 - 1), (2**63 - 1, 7), (9, 9), (9, 9)]
    rows = common.components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()
    got = {x["id"]: x["root"] for x in rows}
    want = roots(pairs, {i for p in pairs for i in p})
    assert len(rows) == len(got) and all(want[i] == got.get(i, i) for i in want)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_take_few_jobs(spark):
    """Every query takes of the driver's memory; the pipeline's near-duplicate stage joins components six times."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    spark.sparkContext.setJobGroup("few-edges", "components")
    rows = common.components(edges).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {(r["id"], r["root"]) for r in rows} == {(i, 0) for i in range(1, 41)} and jobs <= 10


def test_mixing_matches_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.sql(mixing.SQL)
    got = queries.op1_mixing(spark, SF)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_mixing_targets(spark):
    sources = [0] * 60 + [1] * 20 + [2] * 4
    rows = [(i, "w " * 9, f"s{s}" if s else None, "t") for i, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight string")
    out = mixing.mix(docs, entropy_share=0.9, repeats=None, block_tokens=50).collect()
    weights = {r["source"]: r["weight"] for r in out}
    assert -sum(w * math.log(w) for w in weights.values()) == pytest.approx(0.9 * math.log(3), abs=1e-4)
    used = collections.Counter()
    for r in out:
        used[r["source"]] += r["n_tokens"]
    assert all(0 <= weights[s] * 840 - used[s] < 10 + 1e-3 for s in weights)
    per = collections.Counter((r["doc_id"], r["epoch"]) for r in out)
    assert set(per.values()) == {1}
    capped = mixing.mix(docs, entropy_share=0.9, repeats=1.5, block_tokens=50).collect()
    assert max(collections.Counter(r["doc_id"] for r in capped).values()) <= 2
    whole = mixing.mix(docs, entropy_share=None, repeats=2.0, budget="all", keep=docs.columns)
    times = collections.Counter(r["doc_id"] for r in whole.collect())
    assert set(times) == set(range(84)) and {times[i] for i in range(60)} == {1} and {times[i] for i in range(80, 84)} == {2}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(documents(spark, texts(20))).count() > 0


def test_pipeline(spark):
    """The stages' decisions, against what each may keep."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in p.STAGES[:-1]:
        before = {r["doc_id"] for r in seen.select("doc_id").collect()}
        seen = stage(spark, seen, SF).cache()
        after = [r["doc_id"] for r in seen.select("doc_id").collect()]
        assert seen.columns == columns and set(after) <= before, name
        if name in ("secret_scan", "source_mixing"):
            assert set(after) == before
    out = p.run(spark, SF)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(after)
    assert seen.where("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
