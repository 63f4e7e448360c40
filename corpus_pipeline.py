"""A corpus pipeline over ``documents``: stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import benchmark_matches, bpe, jaccard, quality, queries, run_index
from tidemark.sources.results import materialise, release, stages



def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest id."""
    return jaccard.one_per_group(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat."""
    return run_index.without_repeats(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    return benchmark_matches.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the bytes that they decode to."""
    path, pattern = queries.tokenizer()
    coded = bpe.encode(docs, path, pattern, decoded=True)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", tokens_stage),
]
#: No SQL: the classifier's training cannot be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``, each written to the shared folder and read again.

    What a stage wrote for itself and what it read go once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    earlier = set(stages(spark))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            done = [p for p in stages(spark) if p not in earlier]
            docs = materialise(docs)
            release(spark, done)
    return docs
