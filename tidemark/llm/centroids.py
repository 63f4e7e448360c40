"""Centroid clustering of integer vectors by dictionaries of their distinct subvectors.

Vectors are packed once into shards, in the tasks that read them.  A shard cuts the dimensions
into blocks and keeps, for each block, the distinct subvectors of its vectors and one code per
vector; nothing is lost.  Blocks begin as single dimensions, and neighbours are joined while the
joined dictionary stays under a share of the shard's vectors, so repeated vectors end up as one
code and vectors of few distinct values keep short dictionaries.  A round computes the squared
distance of every dictionary entry to its part of every centroid once and adds the entries'
distances by code; sums per cluster come from counts of (cluster, code).  All of it is integer
arithmetic.

Only shards are read in a round and only ``k`` rows of sums leave it, so a round has no shuffle of
vectors, and a vector that makes up a third of the table costs its codes.  Centroids (k x 64
integers) are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.results import materialise

DIMENSIONS, CLUSTERS, ROUNDS, SALT = 64, 40, 5, 2
#: Components beyond this are set to it: squared distances then fit in a long.
LARGEST = 1 << 26
#: Vectors of a shard, vectors whose distances are held at once, and entries per vector up to which blocks are joined.
SHARD, STEP, SHARE = 1 << 15, 1 << 12, 0.25
SHARDS = "ids array<bigint>, widths array<int>, codes array<binary>, entries array<binary>"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """``vec_id`` and ``q``, the floors of 256 times the components, of every usable vector.

    A vector is usable with exactly ``dimensions`` components, none null or not finite.  Repeated
    rows and rows with a null id count each.
    """
    e = F.col(f"`{embedding}`").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity
    edge = float(LARGEST)
    whole = lambda x: F.floor(F.greatest(F.least(x * 256, F.lit(edge)), F.lit(-edge))).cast("bigint")
    return vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), e.alias("e")).where((F.size("e") == dimensions) & F.coalesce(fine, F.lit(False))).select(
        "vec_id", F.transform("e", whole).alias("q")
    )


def first_centroids(q: DataFrame, clusters: int = CLUSTERS, salt: int = SALT) -> np.ndarray:
    """The vectors with the smallest hash of their id (null ids last; ties by the vector)."""
    key: Column = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = q.select(key.alias("key"), "q").orderBy(F.col("key").asc_nulls_last(), "q").limit(clusters).collect()
    return np.array([r.q for r in rows], np.int64)


def encode(block: np.ndarray, share: float = SHARE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes and distinct subvectors of each block of dimensions."""
    blocks = []
    for column in block.T:
        values, code = np.unique(column, return_inverse=True)
        blocks.append((code, values[:, None]))
    joined = True
    while joined:
        joined, out, k = False, [], 0
        while k < len(blocks):
            if k + 1 < len(blocks) and (both := _join(blocks[k], blocks[k + 1], share * len(block))):
                out.append(both)
                joined, k = True, k + 2
            else:
                out.append(blocks[k])
                k += 1
        blocks = out
    return blocks


def _join(a, b, most: float):
    if max(len(a[1]), len(b[1])) > most:
        return None
    pairs, code = np.unique(a[0].astype(np.int64) * len(b[1]) + b[0], return_inverse=True)
    if len(pairs) > most:
        return None
    return code, np.concatenate((a[1][pairs // len(b[1])], b[1][pairs % len(b[1])]), axis=1)


def shards(q: DataFrame, share: float = SHARE) -> DataFrame:
    """The vectors as dictionary-coded shards, one row per ``SHARD`` vectors of a task."""

    def packed(ids: list, rows: np.ndarray) -> pa.RecordBatch:
        blocks = encode(rows, share)
        small = lambda c, n: c.astype(np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32).tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([[e.shape[1] for _, e in blocks]], pa.list_(pa.int32())),
             pa.array([[small(c, len(e)) for c, e in blocks]], pa.list_(pa.binary())), pa.array([[e.tobytes() for _, e in blocks]], pa.list_(pa.binary()))],
            names=["ids", "widths", "codes", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for batch in batches:
            if not len(batch):
                continue
            ids += batch.column(0).to_pylist()
            rows.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1))
            held += len(batch)
            while held >= SHARD:
                all_rows = np.concatenate(rows)
                yield packed(ids[:SHARD], all_rows[:SHARD])
                ids, rows, held = ids[SHARD:], [all_rows[SHARD:]], held - SHARD
        if held:
            yield packed(ids, np.concatenate(rows))

    return q.mapInArrow(run, SHARDS)


class Shard:
    """A shard's codes and entries, and what a round asks of them."""

    def __init__(self, n: int, widths: list[int], codes: list[bytes], entries: list[bytes]):
        self.n, self.blocks, at = n, [], 0
        for w, c, e in zip(widths, codes, entries):
            values = np.frombuffer(e, np.int64).reshape(-1, w)
            kind = np.uint8 if len(values) <= 1 << 8 else np.uint16 if len(values) <= 1 << 16 else np.uint32
            self.blocks.append((slice(at, at + w), np.frombuffer(c, kind), values))
            at += w

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid (the first of equals) and squared distance of every vector."""
        tables = []
        for dims, _, values in self.blocks:
            d = np.zeros((len(values), len(centroids)), np.int64)
            for x, c in zip(values.T, centroids[:, dims].T):
                d += (x[:, None] - c[None, :]) ** 2
            tables.append(d)
        cluster, distance = np.zeros(self.n, np.int32), np.zeros(self.n, np.int64)
        for i in range(0, self.n, STEP):
            total = sum(d[code[i : i + STEP]] for d, (_, code, _) in zip(tables, self.blocks))
            cluster[i : i + STEP] = total.argmin(axis=1)
            distance[i : i + STEP] = total.min(axis=1)
        return cluster, distance

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Componentwise sums of the vectors of every cluster."""
        parts = []
        for _, code, values in self.blocks:
            counts = np.bincount(cluster.astype(np.int64) * len(values) + code, minlength=k * len(values)).reshape(k, -1)
            parts.append(counts @ values)
        return np.concatenate(parts, axis=1)


def opened(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Shard]]:
    for i in range(len(batch)):
        ids = batch.column(0)[i].values
        yield ids, Shard(len(ids), *(batch.column(c)[i].as_py() for c in (1, 2, 3)))


def _totals(packed: DataFrame, centroids: np.ndarray, with_sums: bool) -> dict[tuple[int, int], int]:
    """Count (dimension -2), inertia (-1) and componentwise sums per (cluster, dimension): k rows times dimensions."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, inertia, sums = np.zeros(k, np.int64), [0] * k, np.zeros((k, centroids.shape[1]), np.int64)
        for batch in batches:
            for _, shard in opened(batch):
                cluster, distance = shard.nearest(centroids)
                count += np.bincount(cluster, minlength=k)
                if with_sums:
                    sums += shard.sums(cluster, k)
                else:
                    order = np.argsort(cluster, kind="stable")
                    for c, part in zip(range(k), np.split(distance[order], np.searchsorted(cluster[order], np.arange(1, k)))):
                        inertia[c] += int(part.sum(dtype=object)) if len(part) else 0
        told = [(c, d, int(v)) for c in range(k) if count[c] for d, v in [(-2, count[c]), (-1, inertia[c]), *(enumerate(sums[c]) if with_sums else ())]]
        yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in told], pa.int32()), pa.array([t[1] for t in told], pa.int32()), pa.array([str(t[2]) for t in told], pa.string())], names=["cluster", "dim", "total"])

    rows = packed.mapInArrow(run, "cluster int, dim int, total string").groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {(r["cluster"], r["dim"]): int(r["total"]) for r in rows.collect()}


def moved(centroids: np.ndarray, totals: dict[tuple[int, int], int]) -> np.ndarray:
    """Floors of the means; an empty cluster's centroid stays."""
    out = centroids.copy()
    for c in range(len(out)):
        if n := totals.get((c, -2)):
            out[c] = [totals[c, d] // n for d in range(out.shape[1])]
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: int = SALT, dimensions: int = DIMENSIONS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector.

    Null, short, long and not finite vectors have no row (see ``quantised``).  Repeated rows count
    and come out each; among vectors with one id, the smaller one begins a cluster first.  With
    fewer vectors than clusters each begins one; equal distances go to the smaller number.  A
    table without usable vectors gives no rows.  Inertia beyond a long is given as the largest one.
    Other columns are not read.
    """
    q = quantised(vectors, dimensions=dimensions)
    centroids = first_centroids(q, clusters, salt)
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        return q.sparkSession.createDataFrame([], schema)
    packed = materialise(shards(q))
    for _ in range(rounds):
        centroids = moved(centroids, _totals(packed, centroids, True))
    ends = _totals(packed, centroids, False)
    most = (1 << 63) - 1
    inertia = np.array([min(ends.get((c, -1), 0), most) for c in range(len(centroids))], np.int64)
    whole = min(sum(v for (_, d), v in ends.items() if d == -1), most)
    digests = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, shard in opened(batch):
                c, d = shard.nearest(centroids)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(c), pa.array(d), pa.array(inertia[c]), pa.array(np.full(shard.n, whole)), pa.array(digests[c], pa.string())],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return packed.mapInArrow(run, schema)
