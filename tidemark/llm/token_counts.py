"""Token counts that follow edits.

A document's pre-tokens are the leaves of a tree that holds their characters and tokens; every
inner node holds the sums of its children.  The tree finds the leaves that an edit touches by
descending on characters.  Splitting starts again two pre-tokens before the edit and ends at the
first boundary past it that was one before (from there on the split is what it was); only those
pre-tokens are encoded, and only the sums above them change.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import STEP, Encoder
from tidemark.llm.columns import pieces, text_bytes

#: Pre-tokens under one lowest node.
LEAF = 64
#: Pre-tokens before an edit that it may change: a run of white space makes two, and an edit after
#: them can join them.
CONTEXT = 2


class CountTree:
    """Characters and tokens of pre-tokens, under sums."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self._build(np.array((chars, tokens), np.int64))

    def _build(self, flat: np.ndarray) -> None:
        starts = range(0, max(1, flat.shape[1]), LEAF)
        self.leaves = [flat[:, k : k + LEAF] for k in starts]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        if flat.shape[1]:
            self.sums[self.size : self.size + len(starts)] = np.add.reduceat(flat, starts, axis=1).T
        half = self.size
        while half > 1:
            half //= 2
            self.sums[half : 2 * half] = self.sums[2 * half : 4 * half : 2] + self.sums[2 * half + 1 : 4 * half : 2]

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, char: int) -> tuple[int, int, int]:
        """Leaf node, place in it and first character of the pre-token that holds a character (the last one at the end)."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if char >= before + self.sums[k, 0] and self.sums[k + 1, 0]:
                before += int(self.sums[k, 0])
                k += 1
        leaf = self.leaves[k - self.size]
        ends = before + np.cumsum(leaf[0])
        at = min(int(np.searchsorted(ends, char, "right")), max(0, leaf.shape[1] - 1))
        return k - self.size, at, int(ends[at] - leaf[0, at]) if leaf.shape[1] else before

    def replace(self, first: tuple[int, int], last: tuple[int, int], new: np.ndarray) -> None:
        """Put ``new`` leaves in place of those from ``first`` to before ``last`` (node, place)."""
        head, tail = self.leaves[first[0]][:, : first[1]], self.leaves[last[0]][:, last[1] :]
        self.leaves[first[0]] = np.concatenate((head, new, tail) if first[0] == last[0] else (head, new), axis=1)
        for k in range(first[0] + 1, last[0]):
            self.leaves[k] = tail[:, :0]
        if last[0] != first[0]:
            self.leaves[last[0]] = tail
        if self.leaves[first[0]].shape[1] > 4 * LEAF:
            self._build(np.concatenate(self.leaves, axis=1))
            return
        for k in range(first[0], last[0] + 1):
            self.sums[self.size + k] = self.leaves[k].sum(1)
        touched = {(self.size + k) // 2 for k in range(first[0], last[0] + 1)}
        while touched - {0}:
            for k in touched:
                self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]
            touched = {k // 2 for k in touched} - {0}


def edited(text: str, tree: CountTree, start: int, end: int, by: str, enc: Encoder) -> tuple[str, int]:
    """Replace characters [start, end) of the text and follow in the tree; the new text and pre-tokens encoded."""
    start = max(0, min(start, len(text)))
    end = max(start, min(end, len(text)))
    new = text[:start] + by + text[end:]
    node, place, first = tree.find(max(0, start))
    for _ in range(CONTEXT):
        if first > 0:
            node, place, first = tree.find(first - 1)
    shift = len(by) - (end - start)
    at, fresh = first, []
    old_node, old_place, old = tree.find(end) if tree.chars else (0, 0, 0)
    if old < end:  # the boundary at or after the edit
        old_place += 1
        old = int(old + tree.leaves[old_node][0, old_place - 1]) if tree.leaves[old_node].shape[1] else old
    for m in enc.split.finditer(new, first):
        while old + shift < at and old < len(text):
            old_node, old_place, old = _step(tree, old_node, old_place, old)
        if at == old + shift and at >= start + len(by):
            break
        fresh.append(m[0])
        at = m.end()
    else:
        old_node, old_place = len(tree.leaves) - 1, tree.leaves[-1].shape[1]
    tokens = [len(enc.piece(p)) for p in fresh]
    tree.replace((node, place), (old_node, old_place), np.array([[len(p) for p in fresh], tokens], np.int64).reshape(2, -1))
    return new, len(fresh)


def _step(tree: CountTree, node: int, place: int, char: int) -> tuple[int, int, int]:
    while place >= tree.leaves[node].shape[1] and node + 1 < len(tree.leaves):
        node, place = node + 1, 0
    return (node, place + 1, char + int(tree.leaves[node][0, place])) if place < tree.leaves[node].shape[1] else (node, place, char)


def with_trees(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``chars, tokens array<int>``: the leaves of each row's tree; null and empty texts have none.

    Columns of these names that the frame has are replaced.
    """
    docs = docs.drop("chars", "tokens")
    schema = T.StructType([*docs.schema.fields, T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def run(batches):
        enc = Encoder.of(path, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for i, j in pieces(text_bytes(column)[1], STEP):
                part = batch.slice(i, j - i)
                split, counts = enc.counts_of(column.slice(i, j - i).to_pylist())
                ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in split]))).astype(np.int32))
                chars = np.array([len(p) for x in split for p in x], np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(chars)), pa.ListArray.from_arrays(ends, pa.array(counts))], names=schema.names)

    return docs.mapInArrow(run, schema)


def recount(documents: DataFrame, path: str, pattern: str, stored: bool | None = None, leaves: bool = True) -> DataFrame:
    """Token counts of every row before and after its edits.

    Takes ``doc_id, text, chars, tokens`` (from ``with_trees``; without these two, where they are not
    arrays of int, or if ``stored`` is false, the trees are built here) and ``edits``, an array of
    (start, stop, by) in characters of the text as the earlier edits left it; places outside it
    are moved to its ends, an edit without places is ignored, null ``by`` is empty.  Returns ``doc_id, n_tokens, n_tokens_edited, n_pretokens, n_encoded,
    chars, tokens``: the last two are the new tree's leaves, to be kept for the next edits; without
    ``leaves`` they are left out.
    """
    kinds = dict(documents.dtypes)
    kept = all(kinds.get(c) == "array<int>" for c in ("chars", "tokens")) if stored is None else stored
    src = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), "edits", *(["chars", "tokens"] if kept else []))
    numbers_of = T.ArrayType(T.IntegerType())
    longs = [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_tokens_edited", "n_pretokens", "n_encoded")]
    more = [T.StructField("chars", numbers_of), T.StructField("tokens", numbers_of)] if leaves else []
    schema = T.StructType([src.schema["doc_id"], *longs, *more])

    def run(batches):
        enc = Encoder.of(path, pattern)
        for batch in batches:
            text = batch.column(1)
            for i, j in pieces(text_bytes(text)[1], STEP):
                out, flats, at = [], [], 0
                split, counts = ([], None) if kept else enc.counts_of(text.slice(i, j - i).to_pylist())
                for k in range(i, j):
                    if kept:
                        tree = CountTree(*(batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (3, 4)))
                    else:
                        words = split[k - i]
                        tree = CountTree(np.fromiter(map(len, words), np.int64, len(words)), counts[at : at + len(words)])
                        at += len(words)
                    before, now, encoded = tree.tokens, text[k].as_py(), 0
                    for e in batch.column(2)[k].as_py() or ():
                        if e is None or e["start"] is None or e["stop"] is None:
                            continue
                        now, n = edited(now, tree, e["start"], e["stop"], e["by"] or "", enc)
                        encoded += n
                    if leaves:
                        flats.append(np.concatenate(tree.leaves, axis=1).astype(np.int32))
                    out.append((before, tree.tokens, sum(x.shape[1] for x in tree.leaves), encoded))
                numbers = [pa.array(c, pa.int64()) for c in zip(*out)]
                ends = pa.array(np.concatenate(([0], np.cumsum([x.shape[1] for x in flats]))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[r] for x in flats]))) for r in (0, 1)] if leaves else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *numbers, *lists], names=schema.names)

    return src.mapInArrow(run, schema)


def sample_edits(text: Column) -> Column:
    """Three edits of the registered query: words moved, an insertion and a cut, placed by length."""
    n = F.length(text)
    edit = lambda a, b, by: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), by.alias("by"))
    third, half = F.floor(n / 3), F.floor(n / 2)
    return F.array(edit(third, third + 20, F.substring(text, -30, 30)), edit(half, half, F.lit(" revised  text")), edit(n - 10, n + 10, F.lit("")))
