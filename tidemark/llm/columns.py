"""Arrow text columns as flat byte arrays, and hashing of byte runs without a Python loop per row."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; a longer text is handled alone.
PIECE = 4 << 20


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the int64 offsets of its rows; null is empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    a = pc.fill_null(a.cast(pa.large_binary()), b"")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_factors = np.zeros(0, np.uint64)


def factors(n: int) -> np.ndarray:
    """One odd random factor per position."""
    global _factors
    if len(_factors) < n:
        _factors = mix(np.arange(1, max(n, 1024) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _factors[:n]


def run_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run; the runs are disjoint, ascending and not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.concatenate(([0], np.cumsum(lengths)))
    at = np.arange(first[-1]) - np.repeat(first[:-1], lengths)
    taken = data[at + np.repeat(starts, lengths)].astype(np.uint64)
    taken += np.uint64(1)
    taken *= factors(int(lengths.max()))[at]
    return mix(np.add.reduceat(taken, first[:-1]) + lengths.astype(np.uint64))


def byte_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """256 booleans, true in the closed ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Starts, lengths and row of the maximal runs of ``inside`` bytes; none crosses a row."""
    w = np.zeros(len(data) + 1, bool)
    w[:-1] = inside[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = w[:-1]
    before[offsets] = False
    starts = np.flatnonzero(w & ~before)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = w[1:]
    inner = offsets[1:][offsets[1:] > 0] - 1
    after[inner] = False
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends - starts, np.searchsorted(offsets, starts, "right") - 1


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, whatever else the frame carries."""
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))


def give_back() -> None:
    """Give memory that was freed back to the system, where the C library can: workers live as long as the session."""
    if name := ctypes.util.find_library("c"):
        trim = getattr(ctypes.CDLL(name), "malloc_trim", None)
        if trim is not None:
            trim(0)
