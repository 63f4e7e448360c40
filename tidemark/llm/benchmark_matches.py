"""Benchmark decontamination by suffix arrays of the training words.

The documents of a task are cut into shards of about a million words.  Each shard gets a suffix
array over its words, ordered to the depth of a window, and every suffix of every benchmark item
is binary-searched in it, word by word, in one vectorised search.  Hits on one diagonal of an
item and a document join into the longest verbatim matches.  The benchmark is the small side: its
size is checked, then every task gets a copy.  Documents are never shuffled and a shard is all
that a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.columns import LOWER, byte_table, documents, pieces, run_hashes, text_bytes, word_runs

#: Words of a window.
WINDOW = 10
#: Largest benchmark, in bytes of text, that is sent to every task; a larger one is refused.
MOST_BENCHMARK = 64 << 20
#: Bytes of document text per shard.
SHARD = 2 << 20
#: Digits, letters and every byte of a character beyond ASCII.
WORD = byte_table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
SPAN = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType())])


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows in order, and the row of each."""
    low = LOWER[data]
    starts, lengths, row = word_runs(low, offsets, WORD)
    return run_hashes(low, starts, lengths), row


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Positions ordered by the ``WINDOW`` words that follow; word 0 ends a row and sorts first."""
    bits = max(1, int(words.max(initial=0)).bit_length(), len(words).bit_length())
    per = 63 // bits
    rank, depth = words.astype(np.uint64), 1
    order = np.zeros(len(words), np.int64)
    while depth < WINDOW:
        key = np.zeros(len(rank), np.uint64)
        for k in range(per):
            key <<= np.uint64(bits)
            at = k * depth
            if at < len(rank):
                key[: len(rank) - at] |= rank[at:]
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1]))).astype(np.uint64)
        rank += np.uint64(1)
        depth *= per
    return order


def search(words: np.ndarray, order: np.ndarray, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval of the suffix array whose suffixes begin with each pattern (a padded row)."""
    lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(order), np.int64)
    padded = np.concatenate((words, np.zeros(WINDOW, words.dtype)))
    for d in range(WINDOW):
        open_ = np.flatnonzero((lengths > d) & (lo < hi))
        if not len(open_):
            break
        want = patterns[open_, d]
        ends = []
        for above in (False, True):
            a, b = lo[open_].copy(), hi[open_].copy()
            while (run := a < b).any():
                mid = (a + b) >> 1
                got = padded[order[np.minimum(mid, len(order) - 1)] + d]
                right = run & ((got <= want) if above else (got < want))
                a = np.where(right, mid + 1, a)
                b = np.where(run & ~right, mid, b)
            ends.append(a)
        lo[open_], hi[open_] = ends
    return lo, hi


class Windows:
    """The benchmark's windows: each word once, and the item, first word and length of each window."""

    def __init__(self, items: list[tuple[str | None, str]]) -> None:
        self.names = [i for i, _ in items]
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        words, row = words_of(data, offsets)
        self.vocabulary, code = np.unique(words, return_inverse=True)
        self.code = code.astype(np.int32)
        first = np.searchsorted(row, np.arange(len(items) + 1))
        n = first[1:] - first[:-1]
        count = np.where(n >= WINDOW, n - WINDOW + 1, (n > 0).astype(n.dtype))
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), count)
        self.place = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        self.length = np.minimum(WINDOW, n).astype(np.int8)[self.item]
        self.first = first[:-1]

    def present(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose words all occur among the sorted ``known``; their words as places in it, padded, and lengths."""
        at = np.minimum(np.searchsorted(known, self.vocabulary), len(known) - 1)
        rank = np.where(known[at] == self.vocabulary, at + 1, 0).astype(np.int32)[self.code]
        missing = np.concatenate((np.zeros(1, np.int32), np.cumsum(rank == 0, dtype=np.int32)))
        start = self.first[self.item] + self.place
        alive = np.flatnonzero(missing[start + self.length] == missing[start])
        length = self.length[alive].astype(np.int64)
        inside = np.arange(WINDOW) < length[:, None]
        words = np.where(inside, np.concatenate((rank, np.zeros(WINDOW, np.int32)))[start[alive][:, None] + np.arange(WINDOW)], 0)
        return alive, words, length

    def matches(self, data: np.ndarray, offsets: np.ndarray):
        """Word counts and hit counts of a shard's rows, and its longest matches (row, item, start, words)."""
        rows = len(offsets) - 1
        words, row = words_of(data, offsets)
        n_words = np.bincount(row, minlength=rows)
        none = np.zeros(0, np.int64)
        if not len(words) or not len(self.item):
            return n_words, np.zeros(rows, np.int64), (none, none, none, none)
        known, ids = np.unique(words, return_inverse=True)
        first = np.concatenate(([0], np.cumsum(n_words)))
        at = np.arange(len(words)) + row  # one end mark after every row
        text = np.zeros(len(words) + rows, np.int64)
        text[at] = ids + 1
        order = suffix_array(text)
        alive, patterns, lengths = self.present(known)
        lo, hi = search(text, order, patterns, lengths)
        n = hi - lo
        which = np.repeat(alive, n)
        hit = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        in_row = np.searchsorted(first[:-1] + np.arange(rows), hit, "right") - 1
        start = hit - first[in_row] - in_row
        length = self.length[which].astype(np.int64)
        cover = np.zeros(len(text) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + length, -1)
        covered = np.cumsum(cover[:-1]) > 0
        n_hit = np.bincount(row, weights=covered[at], minlength=rows).astype(np.int64)
        item, diagonal = self.item[which], start - self.place[which]
        by = np.lexsort((start, diagonal, item, in_row))
        in_row, item, diagonal, start, length = in_row[by], item[by], diagonal[by], start[by], length[by]
        if not len(by):
            return n_words, n_hit, (none, none, none, none)
        new = np.ones(len(by), bool)
        new[1:] = (in_row[1:] != in_row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (start[1:] > start[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.concatenate((head[1:], [len(by)])) - 1
        return n_words, n_hit, (in_row[head], item[head], start[head], start[tail] + length[tail] - start[head])


def benchmark_parts(bench: DataFrame) -> list[DataFrame]:
    """Items that have text, in parts of at most ``MOST_BENCHMARK`` bytes (or of one bucket of items).

    Items are dealt into buckets by hash, and buckets are packed into parts by their sizes.
    """
    items = bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = F.sum(F.octet_length("text") + 40).alias("size")
    whole = items.agg(size).first()["size"] or 0
    if whole <= MOST_BENCHMARK:
        return [items]
    n = 16 * -(-whole // MOST_BENCHMARK)
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    parts, room = [], 0
    for r in sorted(dealt.groupBy("bucket").agg(size).collect(), key=lambda r: r["bucket"]):
        if not parts or r["size"] > room:
            parts.append([])
            room = MOST_BENCHMARK
        parts[-1].append(r["bucket"])
        room -= r["size"]
    return [dealt.where(F.col("bucket").isin(p)).drop("bucket") for p in parts]


def find_matches(docs: DataFrame, bench: DataFrame, keep: list[str] = ()) -> DataFrame:
    """``doc_id, n_words, n_hit, matches`` of every document row, with the columns in ``keep``.

    ``matches`` lists the longest verbatim runs as (item_id, start word, words); ``n_hit`` counts
    document words inside any window of an item (10 words, or the whole item if shorter).  Null
    and empty texts have no words; items without text are ignored; an item with a null id hits
    like any other, and its runs have a null ``item_id``; items that share an id count as one.
    A benchmark over ``MOST_BENCHMARK`` bytes is searched part by part, one pass over the
    documents each, and the runs are united.  ``keep`` may not name a result column.
    """
    told = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("matches", T.ArrayType(SPAN))]
    if clash := {f.name for f in told} & set(keep):
        raise ValueError(f"columns to keep that the result has itself: {sorted(clash)}")
    found = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), *[c for c in keep if c not in ("doc_id", "text")])
    schema = T.StructType([*found.schema.fields, *told])
    for k, part in enumerate(benchmark_parts(bench)):
        found = _searched(found, Windows([(r.item_id, r.text) for r in part.collect()]), schema, bool(k))
    return found


def _searched(src: DataFrame, windows: Windows, schema: T.StructType, again: bool) -> DataFrame:
    """One pass with the windows of a part; ``again``: the rows carry the runs of earlier parts."""
    shared = src.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        names = pa.array(w.names, pa.string())
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in pieces(offsets, SHARD):
                n_words, n_hit, (row, item, start, length) = w.matches(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids, part = names.take(pa.array(item, pa.int64())), batch.slice(i, j - i)
                if again:
                    before = part.column(part.num_columns - 1)
                    old = before.flatten()
                    row = np.concatenate((np.repeat(np.arange(j - i), before.value_lengths().to_numpy()), row))
                    by = np.argsort(row, kind="stable")
                    row, ids = row[by], pa.concat_arrays([old.field(0), ids]).take(pa.array(by))
                    start, length = (np.concatenate((old.field(f).to_numpy(), x))[by] for f, x in ((1, start), (2, length)))
                    n_hit = united(row, start, length, j - i)
                    part = pa.RecordBatch.from_arrays(part.columns[:-3], names=schema.names[:-3])
                spans = pa.StructArray.from_arrays([ids, pa.array(start, pa.int64()), pa.array(length, pa.int64())], names=["item_id", "start", "n_words"])
                ends = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), spans)],
                    names=schema.names,
                )

    return src.mapInArrow(run, schema)


def united(row: np.ndarray, start: np.ndarray, length: np.ndarray, rows: int) -> np.ndarray:
    """Places that the runs of each row cover, each counted once."""
    by = np.lexsort((start, row))
    row, start, end = row[by], start[by], (start + length)[by]
    if not len(row):
        return np.zeros(rows, np.int64)
    far = int(end.max()) + 1  # rows laid out one behind the other
    a, z = start + row * far, end + row * far
    reach = np.maximum.accumulate(z)
    before = np.concatenate(([0], reach[:-1]))
    return np.bincount(row, weights=np.maximum(0, z - np.maximum(a, before)), minlength=rows).astype(np.int64)


def decontaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents without any word in a benchmark window, columns as given."""
    names = {c: c if c in ("doc_id", "text") else f"kept_{k}" for k, c in enumerate(docs.columns)}
    found = find_matches(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()]), bench, list(names.values()))
    return found.where("n_hit = 0").select(*[F.col(a).alias(c) for c, a in names.items()])


def report(found: DataFrame) -> DataFrame:
    """Digest columns of ``find_matches``."""
    items = F.array_sort(F.array_distinct(F.array_compact("matches.item_id")))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
