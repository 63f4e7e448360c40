"""Quality classifier: supervised subword embeddings.

A text's features are its words, its word pairs, the repetitions among its words, and its byte
3-grams and 4-grams, hashed into one table of learned vectors.  The document vector is the mean
over features (each family has the same mass) and a softmax over two classes reads it.  Training
is numpy stochastic gradient descent in one task over a bounded sample of labelled rows.  As the
score is linear in the document vector, scoring needs one number per bucket, so the model that
tasks get has a fixed size and documents are scored where they are read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.columns import byte_table, give_back, mix, pieces, run_hashes, text_bytes, word_runs

#: Rows of the table of vectors, as a power of two, and the vectors' length.
BITS, WIDTH = 17, 8
#: Bounds of the training sample: labelled rows, and bytes of their texts.
MOST_ROWS, MOST_BYTES = 6000, 32 << 20
EPOCHS, RATE, SEED = 6, 0.5, 11
#: Score from which a document is kept.
KEEP = 0.3
#: Bytes of text handled at once.
STEP = 1 << 20
#: Words are runs of anything but ASCII white space.
NOT_SPACE = ~byte_table([(0x09, 0x0D), (0x20, 0x20)])
FAMILIES = 5


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents whose labels are never learned."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - BITS)).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family its buckets in order and the bounds of each row in them."""
    starts, lengths, row = word_runs(data, offsets, NOT_SPACE)
    words = run_hashes(data, starts, lengths)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    back = [np.concatenate((np.zeros(k, np.uint64), words[:-k] if k < len(words) else words[:0]))[: len(words)] for k in (1, 2, 3, 4)]
    same = sum(((words == b).astype(np.uint64) << np.uint64(k) for k, b in enumerate(back)), np.zeros(len(words), np.uint64))
    out = [
        (_bucket(words), bounds),
        (_bucket(words * np.uint64(3) + back[0]), bounds),
        (_bucket(same + np.uint64(77)), bounds),
    ]
    wide = data.astype(np.uint32)
    for n in (3, 4):
        h = np.zeros(max(0, len(wide) - n + 1), np.uint32)
        for k in range(n):
            h |= wide[k : k + len(h)] << np.uint32(8 * k)
        h *= np.uint32(2654435761)
        last = np.maximum(offsets[1:] - n + 1, offsets[:-1])
        out.append(((h >> np.uint32(32 - BITS)).astype(np.int32), np.stack((offsets[:-1], last))))
    return out


def _spans(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (bounds[:-1], bounds[1:]) if bounds.ndim == 1 else (bounds[0], bounds[1])


def sparse(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their weights for every row; the weights of a row sum to one."""
    families = [(b, *_spans(x)) for b, x in features(data, offsets)]
    out = []
    for k in range(len(offsets) - 1):
        parts = [b[s[k] : e[k]] for b, s, e in families]
        parts = [p for p in parts if len(p)]
        buckets = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        weight = np.concatenate([np.full(len(p), 1 / (FAMILIES * len(p))) for p in parts]) if parts else np.zeros(0)
        distinct, at = np.unique(buckets, return_inverse=True)
        out.append((distinct, np.bincount(at, weights=weight, minlength=len(distinct)).astype(np.float32)))
    return out


def packed(buckets: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An example in half its bytes: steps between buckets, distinct weights, and which one each has."""
    steps, (values, code) = np.diff(buckets, prepend=0), np.unique(weight, return_inverse=True)
    small = lambda x: x.astype(np.uint16 if x.max(initial=0) < 1 << 16 else np.uint32)
    return small(steps), values, small(code)


def unpacked(example: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps, values, code = example
    return np.cumsum(steps, dtype=np.int32), values[code]


def train(examples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Log odds of label 1 per bucket and at no features, by stochastic gradient descent."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, 2), np.float32)
    share = np.clip(labels.mean(), 0.02, 0.98) if len(labels) else 0.5
    bias = np.log(np.array([1 - share, share])).astype(np.float32)
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            rate = RATE * (1 - done / steps) * 20
            done += 1
            buckets, weight = unpacked(examples[k])
            rows = vectors[buckets]
            doc = weight @ rows
            logits = doc @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = out @ p
            out -= (rate * 0.1) * np.outer(doc, p)
            bias -= (rate * 0.005) * p
            vectors[buckets] = rows - rate * np.outer(weight, back)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def scores(data: np.ndarray, offsets: np.ndarray, odds: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for every row."""
    total = np.full(len(offsets) - 1, bias)
    for buckets, bounds in features(data, offsets):
        s, e = _spans(bounds)
        run = np.concatenate(([0.0], np.cumsum(odds[buckets], dtype=np.float64)))
        at = len(run) - 1  # a short row at the end begins beyond the last n-gram
        total += (run[np.minimum(e, at)] - run[np.minimum(s, at)]) / (FAMILIES * np.maximum(e - s, 1))
    return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """A model from labelled rows outside the held-out fifth; nothing but texts and labels is read.

    The sample is the ``MOST_ROWS`` labelled documents with the smallest hash of their id, as far
    as ``MOST_BYTES`` of text.  Rows with a null id or label are left out.  Without labelled rows
    every score is one half.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    key = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    ids = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(key, "doc_id").limit(MOST_ROWS)
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = text.join(F.broadcast(ids), "doc_id").where(F.octet_length("text") <= MOST_BYTES).orderBy(key, "doc_id", "text").limit(MOST_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        examples, marks, used = [], [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            fits = int(np.searchsorted(offsets, MOST_BYTES - used, "right")) - 1
            for i, j in pieces(offsets[: max(fits, 0) + 1], STEP):
                examples += [packed(*x) for x in sparse(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
            marks += batch.column(1).to_pylist()[: max(fits, 0)]
            used += int(offsets[-1])
        odds, bias = train(examples, np.array(marks, np.int64)) if marks else (np.zeros(1 << BITS, np.float32), 0.0)
        examples.clear()
        give_back()
        yield pa.RecordBatch.from_pydict({"odds": [odds.tobytes()], "bias": [bias]})

    got = rows.select("text", "label").coalesce(1).mapInArrow(run, "odds binary, bias double").collect()
    return (np.frombuffer(got[0].odds, np.float32), got[0].bias) if got else (np.zeros(1 << BITS, np.float32), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Every row with its columns, and ``quality_score``; null and empty texts get the model's prior."""
    columns = docs.columns
    src = docs.select(F.col("text").cast("string").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([src.schema["_row"], T.StructField("quality_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, bias = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            parts = [scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], odds, bias) for i, j in pieces(offsets, STEP)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.concatenate(parts) if parts else [], pa.float64())], names=["_row", "quality_score"])
        give_back()

    return src.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document row."""
    s = score(docs.select("doc_id", "text"), fit(docs, labels))
    return s.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.coalesce(held_out(F.col("_row.doc_id")), F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= KEEP).cast("int").alias("predicted"),
    )


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, columns as given."""
    return score(docs, fit(docs, labels)).where(F.col("quality_score") >= KEEP).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
