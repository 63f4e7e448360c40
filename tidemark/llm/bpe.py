"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

For one pre-token every leaf of the tree holds the rank of the pair that starts at that byte (or
none), every inner node the smaller rank of its children.  The root names the best pair, the way
down that prefers the left child finds its leftmost place, and a merge changes three leaves, so
a pre-token of n bytes takes O(n log n) however long it is.

Encoding and decoding are maps: no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.columns import documents, give_back, mix, pieces, text_bytes

NONE = 1 << 60
#: Distinct pre-tokens remembered per Python worker.
REMEMBERED = 150_000
#: Bytes of text encoded at once.
STEP = 1 << 20

Ranks = dict[bytes, int]


def read_ranks(path: str) -> Ranks:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: Ranks) -> list[int]:
    """Token ids of one pre-token."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], NONE)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    after = list(range(1, n + 2))  # the next live position; n is the end
    before = list(range(-1, n))

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a <= b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while (best := tree[1]) != NONE:
        k = 1
        while k < size:
            k *= 2
            if tree[k] != best:
                k += 1
        i = k - size
        j = after[i]
        end = after[i] = after[j]
        if end < n:
            before[end] = i
        put(j, NONE)
        put(i, get(piece[i : after[end]], NONE) if end < n else NONE)
        if (p := before[i]) >= 0:
            put(p, get(piece[p:end], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class PairTable:
    """Rank of the token that two neighbouring tokens make, looked up for whole arrays of pairs."""

    def __init__(self, ranks: Ranks) -> None:
        get, keys, values = ranks.get, [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a = get(token[:cut])
                b = get(token[cut:]) if a is not None else None
                if b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE, np.int64)
        left, rank = np.array(keys, np.uint64), np.array(values, np.int64)
        at = self._slot(left)
        while len(left):
            free = np.flatnonzero(self.values[at] == NONE)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = left[put], rank[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, rank, at = left[rest], rank[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at, out, open_ = self._slot(keys), np.full(len(keys), NONE, np.int64), np.arange(len(keys))
        while len(open_):
            found = self.values[at]
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = found[hit]
            go = ~hit & (found != NONE)
            open_, at = open_[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out


def merge_many(group: list[bytes], width: int, table: PairTable, single: np.ndarray) -> list[bytes]:
    """``merge_piece`` for many pre-tokens of at most ``width`` bytes, a row of every tree level each.

    Returns the ids of each as packed int32.
    """
    m = len(group)
    size = np.array([len(p) for p in group])
    inside = np.arange(width) < size[:, None]
    token = np.zeros((m, width), np.int64)
    token[inside] = single[np.frombuffer(b"".join(group), np.uint8)]
    after = np.tile(np.arange(1, width + 1), (m, 1))
    before = np.tile(np.arange(-1, width - 1), (m, 1))
    live = inside.copy()
    pairs = inside[:, 1:]
    leaf = np.full((m, width), NONE, np.int64)
    leaf[:, :-1][pairs] = table.rank(token[:, :-1][pairs], token[:, 1:][pairs])
    levels = [leaf]
    while levels[-1].shape[1] > 1:
        levels.append(np.minimum(levels[-1][:, ::2], levels[-1][:, 1::2]))
    rows = np.flatnonzero(levels[-1][:, 0] != NONE)
    while len(rows):
        best = levels[-1][rows, 0]
        i = np.zeros(len(rows), np.int64)
        for level in levels[-2::-1]:
            i = 2 * i
            i += level[rows, i] != best
        j = after[rows, i]
        end = after[rows, j]
        live[rows, j] = False
        token[rows, i], after[rows, i] = best, end
        leaf[rows, j] = NONE
        more = end < size[rows]
        before[rows[more], end[more]] = i[more]
        fresh = np.full(len(rows), NONE, np.int64)
        fresh[more] = table.rank(best[more], token[rows[more], end[more]])
        leaf[rows, i] = fresh
        p = before[rows, i]
        has = p >= 0
        leaf[rows[has], p[has]] = table.rank(token[rows[has], p[has]], best[has])
        for r, at in ((rows, i), (rows, j), (rows[has], p[has])):
            for low, high in zip(levels, levels[1:]):
                at = at >> 1
                high[r, at] = np.minimum(low[r, 2 * at], low[r, 2 * at + 1])
        rows = rows[levels[-1][rows, 0] != NONE]
    flat, ends = token[live].astype(np.int32).tobytes(), np.cumsum(4 * live.sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class Encoder:
    """Pre-token pattern and ranks, with a bounded memory of pre-tokens already encoded."""

    _made: dict[tuple[str, str], Encoder] = {}

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks, self.split = read_ranks(path), regex.compile(pattern)
        self.table = PairTable(self.ranks)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Encoder:
        """One encoder per worker process, kept between tasks."""
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Packed ids of pre-tokens not met before."""
        coded = [(t, t.encode()) for t in fresh]
        out = {t: _packed([self.ranks[b]]) for t, b in coded if b in self.ranks}
        rest = [x for x in coded if x[0] not in out]
        for width in (8, 16, 32):
            group = [x for x in rest if width // 2 < max(5, len(x[1])) <= width]
            for k in range(0, len(group), 8192):
                part = group[k : k + 8192]
                out.update(zip((t for t, _ in part), merge_many([b for _, b in part], width, self.table, self.single)))
        out.update((t, _packed(merge_piece(b, self.ranks))) for t, b in rest if len(b) > 32)
        return out

    def split_all(self, texts: list[str | None]) -> tuple[list[list[str]], dict[str, bytes]]:
        """Pre-tokens of all texts, and the packed ids of each that occurs."""
        parts = [self.split.findall(t) if t else [] for t in texts]
        fresh = {p for x in parts for p in x}.difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            fresh.update(p for x in parts for p in x)
            self.known.clear()
        extra = self.learn(list(fresh))
        long = {p: ids for p, ids in extra.items() if len(p) > 64}
        self.known.update((p, ids) for p, ids in extra.items() if len(p) <= 64)
        return parts, self.known | long if long else self.known

    def ids_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        parts, known = self.split_all(texts)
        coded = [b"".join(map(known.__getitem__, x)) for x in parts]
        return np.frombuffer(b"".join(coded), np.int32), np.array([len(c) // 4 for c in coded], np.int64)

    def counts_of(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray]:
        """Pre-tokens of all texts, and the number of ids of each in a row."""
        parts, known = self.split_all(texts)
        sizes = map(len, map(known.__getitem__, itertools.chain.from_iterable(parts)))
        return parts, np.fromiter(sizes, np.int32, sum(map(len, parts))) // 4

    def piece(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        got = self.known.get(text)
        return merge_piece(text.encode(), self.ranks) if got is None else np.frombuffer(got, np.int32).tolist()

    def ids(self, text: str) -> list[int]:
        return self.ids_of([text])[0].tolist()


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """``doc_id`` and ``ids array<int>`` of every whole text, one row per input row.

    Null and empty texts have no ids.  Repeated rows and null ids of documents are encoded like
    any other row; further columns are not read.  ``decoded`` adds the bytes that the ids stand
    for (as ``decode`` does) in the same pass.
    """
    src = documents(docs)
    fields = [src.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(path, pattern)
        for batch in batches:
            for i, j in pieces(text_bytes(batch.column(1))[1], STEP):
                part = batch.slice(i, j - i)
                ids, counts = enc.ids_of(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids))
                more = [decoded_bytes(lists, path)] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *more], names=["doc_id", "ids", "decoded"][: 2 + decoded])
        give_back()

    return src.mapInArrow(run, T.StructType(fields[: 2 + decoded]))


@functools.lru_cache(2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens in a row, and where each id's begin."""
    by_id = {i: token for token, i in read_ranks(path).items()}
    words = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
    return np.frombuffer(b"".join(words), np.uint8), np.append(0, np.cumsum([len(w) for w in words]))


def decoded_bytes(lists: pa.ListArray, path: str) -> pa.Array:
    """The bytes that each list of ids stands for; a null list has none."""
    words, first = vocabulary(path)
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    size = first[ids + 1] - first[ids]
    stop = np.append(0, np.cumsum(size))
    data = words[np.arange(stop[-1]) + np.repeat(first[ids] - stop[:-1], size)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(stop[ends]), pa.py_buffer(data)]).cast(pa.binary())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded binary``, the bytes that ``ids`` stand for; null ids give no bytes."""
    names = [*encoded.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded_bytes(batch.column(names.index("ids")), path)], names=names)

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(coded: DataFrame) -> DataFrame:
    """Counts and digests of what ``encode`` and ``decode`` returned."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
