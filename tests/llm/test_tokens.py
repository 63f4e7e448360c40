"""Byte-level BPE and edit-aware counts beside the public library."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import awkward, frame, same_rows, sha
from pyspark.sql import functions as F

from tidemark.llm import bpe, queries, token_counts

PATH, PATTERN = queries.tokenizer()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_encoding_equals_library(library):
    rng, enc = random.Random(1), bpe.Encoder(PATH, PATTERN)
    texts = ["".join(rng.choice("abcthe n'sé日😀 \n\t1₂ß<|endoftext|>") for _ in range(rng.choice((0, 1, 5, 20, 90)))) for _ in range(1500)]
    texts += ["ab" * 20_000, "a" * 33, "日" * 40]
    flat, counts = enc.ids_of(texts)
    ends = np.cumsum(counts)
    assert [flat[e - n : e].tolist() for e, n in zip(ends, counts)] == [library.encode_ordinary(t) for t in texts]
    assert all(bpe.merge_piece(t.encode(), enc.ranks) == np.frombuffer(enc.learn([t])[t], np.int32).tolist() for t in ("thereon", "ééé日", "x", "a" * 31))


def test_documents(spark, library):
    rows = awkward()
    coded = bpe.decode(bpe.encode(frame(spark, rows), PATH, PATTERN), PATH)
    got = [(r.doc_id, list(r.ids), bytes(r.decoded)) for r in coded.collect()]
    same_rows(got, [(d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows])
    both = bpe.encode(frame(spark, rows), PATH, PATTERN, decoded=True)
    same_rows([(r.doc_id, list(r.ids), bytes(r.decoded)) for r in both.collect()], got)
    told = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(coded).collect()}
    assert (7, 2, sha(" ".join(map(str, library.encode_ordinary("One two")))), sha("One two")) in told and (4, 0, sha(""), sha("")) in told
    assert bpe.digests(bpe.decode(bpe.encode(frame(spark, []), PATH, PATTERN), PATH)).count() == 0


def test_edits_equal_full_recount():
    enc, rng = bpe.Encoder(PATH, PATTERN), random.Random(3)
    make = lambda n: "".join(rng.choice(["ab", "the ", " ", "\n", "  ", "'s", "é", "1", "!", " in"]) for _ in range(n))
    for _ in range(300):
        text = make(rng.choice((0, 1, 3, 30, 900)))
        split, counts = enc.counts_of([text])
        tree = token_counts.CountTree(np.array([len(p) for p in split[0]]), counts)
        for _ in range(4):
            a = rng.randint(0, len(text) + 1)
            text, _n = token_counts.edited(text, tree, a, a + rng.choice((0, 1, 5, 300)), make(rng.choice((0, 1, 30))), enc)
            assert np.concatenate(tree.leaves, axis=1)[0].tolist() == [len(p) for p in enc.split.findall(text)]
            assert (tree.tokens, tree.chars) == (len(enc.ids(text)), len(text))


def test_recount_touches_only_the_edit(spark, library):
    rows = awkward()
    docs = token_counts.with_trees(frame(spark, rows).select("doc_id", "text"), PATH, PATTERN)
    got = token_counts.recount(docs.withColumn("edits", token_counts.sample_edits(F.col("text"))), PATH, PATTERN).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(library.encode_ordinary(t or "")) for _, t in rows)
    again = token_counts.recount(docs.drop("chars", "tokens").withColumn("edits", token_counts.sample_edits(F.col("text"))), PATH, PATTERN)
    same_rows(got, again.collect())
    long = [r for r in got if r.doc_id == 9]
    assert len(long) == 2 and all(r.n_encoded < 60 < r.n_pretokens and sum(r.tokens) == r.n_tokens_edited for r in long)
    none = token_counts.recount(docs.withColumn("edits", F.lit(None).cast("array<struct<start:bigint,stop:bigint,by:string>>")), PATH, PATTERN)
    assert all(r.n_tokens == r.n_tokens_edited and r.n_encoded == 0 for r in none.collect())
