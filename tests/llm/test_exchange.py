"""Keys of blocks summed by hash part: exact for any gap and count, and few bytes a key."""

import numpy as np
import pyarrow as pa

from tidemark.llm import blocks

BITS = 48


def drawn(seed, n, bits=BITS):
    return np.unique(np.random.default_rng(seed).integers(0, 1 << bits, n, dtype=np.uint64))


def test_short_numbers_come_back():
    for kind in ("u1", "<u4"):
        top = np.iinfo(kind).max
        values = np.array([0, 1, top - 1, top, top + 1, (1 << 48) - 1, 3], np.uint64)
        small, more = blocks.short(values, kind)
        assert small.dtype == np.dtype(kind) and len(more) == 3 and blocks.whole(small, more).tolist() == values.tolist()


def test_totals_over_blocks(spark):
    rng = np.random.default_rng(5)
    shared = drawn(1, 50)
    near = shared[:3] + np.uint64(1)
    held = {b: np.unique(np.concatenate((shared, near, drawn(10 + b, 400), drawn(20 + b, 300, 20), [0, (1 << BITS) - 1]))).astype(np.uint64) for b in range(4)}
    counts = {b: rng.choice([1, 2, 254, 255, 256, 70_000, (1 << 33)], len(k)) for b, k in held.items()}
    total: dict = {}
    for b, keys in held.items():
        for k, c in zip(keys.tolist(), counts[b].tolist()):
            total[k] = total.get(k, 0) + c
    for parts in (1, 3, 300):
        sent = spark.createDataFrame(pa.concat_tables([blocks.send(b, k, counts[b], parts, BITS) for b, k in held.items()]).to_pandas(), blocks.COUNTED)
        back = blocks.total_by_part(sent, parts, BITS).toArrow()
        for b, keys in held.items():
            got = blocks.answered(back.filter(pa.compute.equal(back.column("block"), b)))
            assert got.dtype == np.int64 and got.tolist() == [total[k] for k in keys.tolist()]
    assert blocks.send(0, np.zeros(0, np.uint64), np.zeros(0, np.int64), 3, BITS).num_rows == 0


def test_bytes_of_a_key(spark):
    """A block of 4 MB has about a million keys; a key and its answer took 17 bytes."""
    keys = drawn(2, 1_100_000)
    sent = blocks.send(0, keys, np.ones(len(keys), np.int64), 32, BITS)
    assert sum(sent.column(c).nbytes for c in ("gaps", "far", "counts", "more")) < 5.1 * len(keys)
    back = blocks.total_by_part(spark.createDataFrame(sent.to_pandas(), blocks.COUNTED), 32, BITS).toArrow()
    assert sum(back.column(c).nbytes for c in ("answer", "more")) < 1.1 * len(keys)
