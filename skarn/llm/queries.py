"""Queries of the training-data operators over the synthetic tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import balls, chat, decontaminate, fingerprint, hmm, jaccard, license_scan, oracle, packing, quality, repair, secret_scan, sharding, toxicity
from skarn.llm.text import table

ARROW_ROWS = "512"


def _arrow(spark: SparkSession) -> None:
    """Batches of few rows: texts can be long, and a Python worker holds a whole batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _arrow(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.scan_secrets(docs).drop("text", "redacted")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are full of control strings."""
    text = oracle.PROBE_TEXT
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.format_conversations(turns))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    _arrow(spark)
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' paths are source/language/id."""
    _arrow(spark)
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan_licenses(docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _arrow(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    _arrow(spark)
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    _arrow(spark)
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    _arrow(spark)
    return jaccard.similarity_components(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    _arrow(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    _arrow(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_digests(repair.damaged(turns), turns)


def op13_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.cluster_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_chat_format": op2_chat_format,
        "op3_fingerprint": op3_fingerprint,
        "op4_hmm_score": op4_hmm_score,
        "op5_license_scan": op5_license_scan,
        "op6_packing": op6_packing,
        "op7_quality": op7_quality,
        "op8_decontamination": op8_decontamination,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_toxicity": op10_toxicity,
        "op11_sharding": op11_sharding,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_ball_clusters": op13_ball_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": oracle.chat_sql(),
        "op9_jaccard_join": oracle.jaccard_sql(),
        "op11_sharding": oracle.sharding_sql(),
        "op12_conversation_repair": oracle.repair_sql(),
        "op13_ball_clusters": oracle.clusters_sql(),
    }
