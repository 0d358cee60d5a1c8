"""A corpus pipeline of five stages; each one's rows are written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import common, mixing, packing, secret_scan, setjoin, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the model, fitted on the labels of these documents, rejects as toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by Operator 5, or by a similarity of 0.8 of their five-word shingles, the one with
    the smallest id stays. Fingerprints at three bits do not reach all pairs of that similarity, so shingles meet besides;
    links of both kinds go on from one another. Texts stand for their documents by 64 bits of their SHA-256."""
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    texts = docs.select(text.alias("h"), "text")
    bits = simhash.near_duplicates(texts, id_column="h").select("h", "component_id")
    sets = setjoin.near_duplicates(texts, shingle=5, similarity=0.8, id_column="h").select("h", "component_id")
    node = lambda h: F.xxhash64(h)
    pairs = bits.unionByName(sets).where("h <> component_id").select(node("h").alias("a"), node("component_id").alias("b")).distinct()
    joined = common.components(common.table(pairs, "near-links")).withColumnRenamed("id", "node")
    rows = docs.select("doc_id", node(text).alias("node")).join(joined, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    lows = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return simhash.keep_smallest(docs, rows.join(lows, "root").select("doc_id", "component_id"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: secrets are replaced by a mark; all documents stay."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: sources are repeated up to twice to come nearer to equal weights; every document stays."""
    return mixing.mix(docs, entropy_share=None, repeats=2.0, budget="all", keep=docs.columns).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: all documents are packed into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("packing", pack),
]

#: Learned models, connected components and tokenization are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.table(docs, f"pipeline-{name}")
    return docs
