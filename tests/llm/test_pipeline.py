"""The pipeline beside its plain version on the smallest tables."""

import public_tokenizers
import tiktoken
from brute import components, cut, hits, repeats, same_rows, sha

import corpus_pipeline
from tidemark.llm import bpe, quality, queries

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    rows = [r for r, (d, _, c) in zip(rows, components(rows)) if d == c]
    rows = [(d, cut(b, drop).decode(errors="ignore")) for (d, _), (b, drop) in zip(rows, repeats([t for _, t in rows]))]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r, (_, n, _) in zip(rows, hits([t for _, t in rows], items)) if not n]
    path, _ = queries.tokenizer()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = [(d, library.encode_ordinary(t), len(library.encode_ordinary(t)), sha(t)) for d, t in rows]
    got = [(r.doc_id, list(r.ids), r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()]
    same_rows(got, want)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_of_no_documents(spark, tmp_path):
    """Empty tables give no rows and the columns of the last stage."""
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"] and out.count() == 0
