"""Blocks of whole documents, and the exchange of hashed keys between blocks and hash parts.

A block is some megabytes of documents, a part a range of hash values.  Every block sends each
part its distinct keys once, with their counts; the part sums over blocks and answers in the same
order.  So a key that every document holds costs one entry per block, no key can make a task large,
and what is shuffled is a few bytes per distinct key of a block: four for a key's distance from the
one before it, one for its count and one for the answer, and eight more where that is too short.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import partitions, text_bytes

#: Bytes of text in a block and in the keys of a part, about.
BLOCK, PART = 4 << 20, 16 << 20
SENT = "part int, block int, keys binary, extra binary"
COUNTED = "part int, block int, gaps binary, far binary, counts binary, more binary"
ANSWER = "block int, part int, answer binary, more binary"


@dataclass(frozen=True)
class Blocked:
    """Rows ``block, doc_id, text, mark`` (the text's hash) and ``rest``, dealt by block, and how many blocks and parts there are."""

    rows: DataFrame
    blocks: int
    parts: int

    def map(self, fn: Callable[[int, pa.Table], Iterator[pa.RecordBatch] | pa.Table], schema: str) -> DataFrame:
        """One call per block, with its documents in a fixed order."""

        def run(key, table):
            return fn(key[0].as_py(), in_order(table))

        return self.rows.groupBy("block").applyInArrow(run, schema)

    def join(self, other: DataFrame, fn: Callable[[int, pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
        """One call per block with its documents and the rows of ``other`` (with ``block``)."""

        def run(key, table, answers):
            return fn(key[0].as_py(), in_order(table), answers)

        return self.rows.groupBy("block").cogroup(other.groupBy("block")).applyInArrow(run, schema)


def in_order(table: pa.Table) -> pa.Table:
    """By id and text, so that every pass over a block numbers its documents alike."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def blocked(docs: DataFrame, block: int = BLOCK, part: int = PART, rest: list[str] = ()) -> Blocked:
    """Documents dealt into blocks by the hash of id and text; null texts are empty.

    ``rest`` names columns to carry along in a struct.
    """
    more = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []
    src = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
    size = src.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    least = partitions(docs)
    n, parts = max(least, -(-size // block)), max(least, -(-size // part))
    src = src.withColumn("mark", F.xxhash64("text"))
    rows = src.withColumn("block", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(n)).cast("int"))
    return Blocked(rows.repartition(least, "block"), n, parts)


def table_bytes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(table.column("text"))


def packed(keys: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each key, a row each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def unpacked(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(-1, width)
    return out.view("<u8")[:, 0]


def part_edges(parts: int, bits: int) -> np.ndarray:
    """Where the parts of ``bits``-wide keys begin: equal ranges of the top 16 bits and more."""
    return np.array([(p << bits) // parts for p in range(parts)], np.uint64)


def part_bounds(distinct: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Where each part begins in sorted ``bits``-wide keys."""
    return np.append(np.searchsorted(distinct, part_edges(parts, bits)), len(distinct))


def short(values: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers in a short type, and in eight bytes those that reach the type's largest."""
    top = np.iinfo(kind).max
    small = np.minimum(values, values.dtype.type(top)).astype(kind)
    return small, values[small == top].astype("<u8")


def whole(small: np.ndarray, more: np.ndarray) -> np.ndarray:
    out = small.astype(np.uint64)
    out[small == np.iinfo(small.dtype).max] = more
    return out


def short_columns(values: np.ndarray, kind: str, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """``short`` numbers cut into rows at ``at``: a binary column of each kind."""
    small, more = short(values, kind)
    big = np.concatenate(([0], np.cumsum(small == np.iinfo(kind).max)))[at]
    cut = lambda x, ends: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
    return cut(small, at), cut(more, big)


def whole_column(small: pa.ChunkedArray, more: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and where each row begins and the last ends."""
    data, offsets = text_bytes(small)
    return whole(data.view(kind), text_bytes(more)[0].view("<u8")), offsets // np.dtype(kind).itemsize


def send(block: int, distinct: np.ndarray, counts: np.ndarray, parts: int, bits: int) -> pa.Table:
    """The rows of ``COUNTED`` for sorted distinct keys of a block: their distances from the part's begin or the key before, and their counts."""
    at = part_bounds(distinct, parts, bits)
    used = np.flatnonzero(at[1:] > at[:-1])
    gaps = np.diff(distinct, prepend=np.uint64(0))
    gaps[at[used]] = distinct[at[used]] - part_edges(parts, bits)[used]
    ends = np.append(at[used], len(distinct))
    gaps, far = short_columns(gaps, "<u4", ends)
    counts, more = short_columns(counts.astype(np.uint64), "u1", ends)
    return pa.table({
        "part": pa.array(used, pa.int32()), "block": pa.array(np.full(len(used), block), pa.int32()), "gaps": gaps, "far": far, "counts": counts, "more": more,
    })


def total_by_part(sent: DataFrame, parts: int, bits: int) -> DataFrame:
    """``ANSWER``: for each key of each block the count over all blocks."""
    inside = ((1 << bits) // parts + 1).bit_length()

    def run(key, table):
        keys, at = whole_column(table.column("gaps"), table.column("far"), "<u4")
        before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(keys, dtype=np.uint64)))
        keys = before[1:] - np.repeat(before[at[:-1]], np.diff(at))
        del before
        totals = sums_of(keys, whole_column(table.column("counts"), table.column("more"), "u1")[0], inside)
        answer, more = short_columns(totals, "u1", at)
        return pa.table({"block": table.column("block"), "part": table.column("part"), "answer": answer, "more": more})

    return sent.groupBy("part").applyInArrow(run, ANSWER)


def sums_of(keys: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """For every entry the sum of counts over entries with its key of ``bits`` bits."""
    if not len(keys):
        return np.zeros(0, np.int64)
    place = np.uint64(len(keys).bit_length())
    if bits + int(place) <= 64:
        ordered = np.sort(keys << place | np.arange(len(keys), dtype=np.uint64))
        at, ordered = (ordered & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64), ordered >> place
    else:
        at = np.argsort(keys)
        ordered = keys[at]
    head = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    out = np.empty(len(keys), np.int64)
    out[at] = np.repeat(np.add.reduceat(counts[at].astype(np.int64), head), np.diff(np.append(head, len(keys))))
    return out


def answered(answers: pa.Table) -> np.ndarray:
    """A block's answers in the order of its sorted keys."""
    rows = answers.sort_by("part")
    return whole_column(rows.column("answer"), rows.column("more"), "u1")[0].astype(np.int64)
