"""Registered queries of the corpus operators, with their check SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import backoff, benchmark_matches, bpe, centroids, jaccard, languages, licenses, paragraph_sketch, prefix_trie, quality, run_index, token_counts, url_trust
from tidemark.llm.check_sql import SQL  # noqa: F401

QUERIES: dict = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """Rank file and pre-token pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@register
def op4_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge_pages(table(spark, sf_dir, "pages")).withColumn("host_score", F.round("host_score", 9))


@register
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path, pattern, decoded=True))


@register
def op9_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches.report(benchmark_matches.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@register
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("n_links")


@register
def op10_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.report(run_index.repeated_spans(table(spark, sf_dir, "documents")))


@register
def op8_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_sketch.compare_versions(table(spark, sf_dir, "documents"))


@register
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.recount(docs.withColumn("edits", token_counts.sample_edits(F.col("text"))), path, pattern, leaves=False)


@register
def op5_backoff_scores_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps back: the first of this operator's queries; the one below stays for its order-2 SQL."""
    s = backoff.score(table(spark, sf_dir, "documents"), order=3)
    return s.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


@register
def op5_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = backoff.score(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


@register
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@register
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@register
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


@register
def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.report(table(spark, sf_dir, "documents"))
