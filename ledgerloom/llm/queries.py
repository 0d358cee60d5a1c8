"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kdtree, kneser_ney, mixing, packing, pii, recompress, secret_scan, signhash, simhash, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.train(docs.where(~kneser_ney.held_out()))
    scored = kneser_ney.score(docs, model)
    return scored.select(
        "doc_id",
        kneser_ney.held_out().alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op3_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(_read(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(_read(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(_read(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "expected_severity", "grade", "p_toxic", "toxic")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(_read(spark, sf_dir, "documents")))


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.digests(recompress.remove_repeats(_read(spark, sf_dir, "documents")))


def op9_signhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signhash.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_kdtree": op3_kdtree,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_recompression": op8_recompression,
    "op9_signhash": op9_signhash,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.SQL,
    "op3_kdtree": kdtree.SQL,
    "op8_recompression": recompress.SQL,
    "op9_signhash": signhash.SQL,
}
