"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs, sentences and pieces of at most ``PIECE_CHARS`` characters; each
gets a digest, repeated pieces one per occurrence.  The sketch hashes every digest to one cell in
each third of its cells (count, xor of digests, xor of checks).  Two versions' sketches subtract
cell by cell, equal pieces cancel, and peeling cells that hold one digest recovers exactly those
that differ.  Where peeling stalls the pair is tried again with four times the cells.  Sketches
of many pairs are built, subtracted and peeled together in arrays.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.columns import mix, partitions

PIECE_CHARS = 80
PIECES = regex.compile(rf"[^\n.!?]{{1,{PIECE_CHARS}}}[\s.!?]*|[\s.!?]+")
#: Cells of the fingerprint and growth on failure; cells are divisible by three.
CELLS, GROWTH = 24, 4
SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
CELL = np.dtype([("count", "<i4"), ("keys", "<u8"), ("checks", "<u4")])
#: Pairs, and bytes of text, handled together.
PAIRS, STEP = 512, 2 << 20
MOST_CELLS = 1 << 21


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of a text's pieces; the k-th occurrence of a piece has one of its own."""
    d = np.sort(np.array([xxhash.xxh64_intdigest(p) for p in PIECES.findall(text)], np.uint64))
    if len(d) > 1:
        new = np.concatenate(([True], d[1:] != d[:-1]))
        at = np.arange(len(d))
        d = d + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) * SALTS[0]
    return mix(d)


def _cells(keys: np.ndarray, owner: np.ndarray, m: int) -> list[np.ndarray]:
    third = m // 3
    return [owner * m + j * third + (mix(keys ^ s) % np.uint64(third)).astype(np.int64) for j, s in enumerate(SALTS)]


def check(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + SALTS[1]) >> np.uint64(32)).astype(np.uint32)


def sketches(keys: np.ndarray, owner: np.ndarray, owners: int, m: int) -> np.ndarray:
    """Sketches of ``m`` cells, a row per owner."""
    out = np.zeros(owners * m, CELL)
    count, xor, checks = np.zeros(owners * m, np.int64), np.zeros(owners * m, np.uint64), np.zeros(owners * m, np.uint32)
    c = check(keys)
    for at in _cells(keys, owner, m):
        count += np.bincount(at, minlength=owners * m)
        np.bitwise_xor.at(xor, at, keys)
        np.bitwise_xor.at(checks, at, c)
    out["count"], out["keys"], out["checks"] = count, xor, checks
    return out.reshape(owners, m)


def subtracted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cell-wise difference of sketches of one size."""
    out = np.zeros(a.shape, CELL)
    out["count"] = a["count"] - b["count"]
    out["keys"], out["checks"] = a["keys"] ^ b["keys"], a["checks"] ^ b["checks"]
    return out


def peel(diff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Recovered (row, digest, side) of differences, side +1 of the first, and which rows are whole."""
    owners, m = diff.shape
    count, xor, checks = (diff[f].reshape(-1).copy() for f in ("count", "keys", "checks"))
    found = []
    open_ = np.flatnonzero(count)
    while len(open_):
        pure = open_[(np.abs(count[open_]) == 1) & (checks[open_] == check(xor[open_]))]
        if not len(pure):
            break
        owner, keys, side = pure // m, xor[pure], count[pure]
        by = np.lexsort((keys, owner))
        by = by[np.concatenate(([True], (owner[by][1:] != owner[by][:-1]) | (keys[by][1:] != keys[by][:-1])))]
        owner, keys, side = owner[by], keys[by], side[by]
        found.append((owner, keys, side))
        cells = _cells(keys, owner, m)
        for at in cells:
            np.subtract.at(count, at, side)
            np.bitwise_xor.at(xor, at, keys)
            np.bitwise_xor.at(checks, at, check(keys))
        open_ = np.unique(np.concatenate(cells))
    whole = ~((count != 0) | (xor != 0)).reshape(owners, m).any(1)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32), whole
    return *(np.concatenate([f[k] for f in found]) for k in range(3)), whole


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def differences(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """For each pair of digest sets how many are in the first alone and in the second alone."""
    out, left, m = np.zeros((len(a), 2), np.int64), np.arange(len(a)), CELLS
    while len(left):
        failed = []
        step = max(1, MOST_CELLS // m)
        for k in range(0, len(left), step):
            part = left[k : k + step]
            diff = subtracted(sketches(*_flat([a[i] for i in part]), len(part), m), sketches(*_flat([b[i] for i in part]), len(part), m))
            row, _, side, whole = peel(diff)
            out[part, 0], out[part, 1] = np.bincount(row[side > 0], minlength=len(part)), np.bincount(row[side < 0], minlength=len(part))
            failed.append(part[~whole])
        left = np.concatenate(failed)
        m *= GROWTH
        hopeless = np.array([m > 64 * (len(a[i]) + len(b[i]) + CELLS) for i in left], bool)
        for i in left[hopeless]:  # digests that no size tells apart
            both = len(np.intersect1d(a[i], b[i]))
            out[i] = len(a[i]) - both, len(b[i]) - both
        left = left[~hopeless]
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> list[float]:
    """Shared share of all pieces (Jaccard) from the recovered differences; two empty texts are alike."""
    out = []
    for x, y, (only_a, only_b) in zip(a, b, differences(a, b).tolist()):
        shared = len(x) - only_a
        out.append(shared / (shared + only_a + only_b) if shared + only_a + only_b else 1.0)
    return out


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    """The smallest sketch and the number of pieces, as text."""
    made = sketches(*_flat(sets), len(sets), CELLS)
    return [f"{len(s):x}:{base64.b64encode(r.tobytes()).decode()}" for s, r in zip(sets, made)]


def with_next(docs: DataFrame) -> tuple[DataFrame, T.DataType]:
    """Documents dealt into ranges of ids, each range in descending order and followed by its next row.

    The ranges' first ids are quantiles of the ids, as many as four per partition; the row with
    that id also goes to the range before as its guest, so each text moves once.  Null ids come
    last; rows that repeat an id follow each other by text.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    src = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), order.alias("ord"))
    n = 4 * partitions(docs)
    got = src.agg(F.percentile_approx("ord", [k / n for k in range(1, n)], 10 * n).alias("q"), F.max("ord").alias("top")).first()
    heads = sorted({*(got.q or []), *([got.top] if got.top is not None else [])})
    steps = [1 << k for k in range(max(1, len(heads).bit_length()), -1, -1)]
    listed = F.array(*[F.lit(h).cast("long") for h in heads]) if heads else F.array(F.lit(0).cast("long"))
    below: Column = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, s: F.when((at + s <= len(heads)) & (F.element_at(listed, F.least(at + s, F.lit(max(1, len(heads))))) < F.col("ord")), at + s).otherwise(at),
    )
    own = src.withColumn("range", below)
    is_head = F.element_at(listed, F.col("range") + 1) == F.col("ord")
    places = F.when(is_head, F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(((F.col("range") + 1) % max(1, len(heads))).alias("range"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct(F.col("range"), F.lit(False).alias("guest")))
    )
    rows = own.select("doc_id", "text", "ord", F.explode(places).alias("p")).select("doc_id", "text", "ord", "p.range", "p.guest")
    return rows.repartition(partitions(docs), "range").sortWithinPartitions("range", "guest", F.desc("ord"), "text"), src.schema["doc_id"].dataType


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str]]:
    """(id, text, next text) of every row that is no guest."""
    last, at, done = None, None, False
    for batch in batches:
        ids, texts, ranges, guests = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "range", "guest"))
        for k in range(len(batch)):
            here, text, guest = ranges[k].as_py(), texts[k].as_py(), guests[k].as_py()
            if here != at:
                at, last, done = here, None, False
            if last is not None and not done:
                yield *last, text
            done = done or guest
            last = None if guest else (ids[k].as_py(), text)


OUT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def compare_versions(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row.

    The edited text ends in the beginning of the next document (descending id, the first after
    the last) instead of its own second half.  Null texts are empty; a single document follows
    itself.
    """
    rows, id_type = with_next(docs)

    def run(batches):
        def flush(group):
            ids, texts, after = zip(*group)
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after)]
            a, e, n = [digests(t) for t in texts], [digests(t) for t in edited], [digests(t) for t in after]
            return pa.RecordBatch.from_arrays([
                pa.array(ids, kind), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(fingerprints(a)), pa.array(fingerprints(e)), pa.array(likeness(a, e), pa.float64()), pa.array(likeness(a, n), pa.float64()),
            ], names=names)

        group, size = [], 0
        for row in neighbours(batches):
            group.append(row)
            size += len(row[1]) + len(row[2])
            if len(group) >= PAIRS or size >= STEP:
                yield flush(group)
                group, size = [], 0
        if group:
            yield flush(group)

    schema = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL(OUT).fields])
    names = schema.names
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(id_type)
    return rows.select("doc_id", "text", "range", "guest").mapInArrow(run, schema)
