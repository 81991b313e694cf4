"""Corpus pipeline: toxicity, near duplicates, decontamination, secrets, packing.

Each stage takes the documents that its predecessor kept and, but for the last, returns the
columns of ``documents``.  Null texts count as empty; an empty table passes through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import decontaminate, jaccard, packing, queries, secret_scan, toxicity
from skarn.llm.text import checkpointed, table
from skarn.session import written

SECRET_MASK = "[SECRET]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    queries._arrow(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked near duplicates (five words, 0.8) stays: the first by id, then by a hash of its
    text (rows without an id come last), whatever other rows have its id.  Rows without words are all alone and stay."""
    queries._arrow(spark)
    row = "_near_duplicates_row"
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()))  # a checkpoint holds texts without compression
    groups = jaccard.similarity_components(keyed, doc_id=row, words=5, percent=80).select(F.col("doc_id").alias(row), "component_id")
    ranked = groups.join(keyed.select(row, F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")), row)
    firsts = checkpointed(ranked.groupBy("component_id").agg(F.min(F.struct("none", "id", "hash", row)).alias("first")).select(f"first.{row}"))
    return keyed.join(firsts, row, "left_semi").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    queries._arrow(spark)
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mask; all documents stay, and their other columns as they are."""
    queries._arrow(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = docs.select("doc_id", "text", F.struct(*others).alias("_others") if others else F.lit(None).alias("_others"))
    masked = secret_scan.scan_secrets(kept, mask=SECRET_MASK)
    own = {"doc_id": F.col("doc_id"), "text": F.col("redacted"), "n_chars": F.length("redacted").cast("bigint")}
    return masked.select(*(own.get(c, F.col("_others").getField(c)).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents kept, placed in sequences of 4096 tokens."""
    queries._arrow(spark)
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
