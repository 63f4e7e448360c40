"""Trie of conversation prefixes, with subtree totals by time-forward processing.

A node is a distinct sequence of turns that some conversation begins with.  Its key is its depth
and two running exclusive-ors of 64-bit hashes of (depth, role, digest of the text), so a
conversation's keys come from running aggregates; turns are cut into buckets of positions, and a
conversation of any length spreads over its buckets.

Totals go from nodes to their parents.  Conversations are dealt into shards, and a shard's trie
holds every node that one of its conversations passes; a node's own value stands in one shard
alone, that of its smallest member, whose path holds all ancestors of the node.  Within a shard the
nodes are sorted by reverse level order (Spark's external sort) and streamed: a node takes its
messages out of a priority queue that spills sorted runs, adds its value and sends the sum to its
parent.  Across shards only shard roots are left to settle: nodes that several shards hold get the
sum of their shards' totals, one row per shard.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.columns import partitions
from tidemark.sources.results import materialise

#: Turns of one bucket of positions, ids of one chunk of a node's members, and messages that a queue holds in memory.
BUCKET, CHUNK, IN_MEMORY = 1024, 4096, 200_000
#: Shards per shuffle partition.
SHARDS = 4
#: Rows of an output batch.
ROWS = 10_000
KEY, PARENT = ["depth", "x", "y"], ["p", "q"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, role, digest, n_bytes`` of every turn, positions from 1.

    Turns are in order of ``turn``, null first; equal ones by role, then MD5 of the text.
    """
    c = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    rows = c.select("conv_id", "turn", F.expr(f"turn div {BUCKET}").alias("bucket"), "role", F.md5(F.encode("text", "UTF-8")).alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    rows = rows.withColumn("bucket", F.coalesce("bucket", F.lit(-(1 << 62))))
    sizes = rows.groupBy("conv_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "bucket").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    placed = rows.withColumn("at", F.row_number().over(inside)).join(sizes, ["conv_id", "bucket"])
    return placed.select("conv_id", (F.col("before") + F.col("at")).alias("position"), "role", "digest", "n_bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, depth, role, digest, n_bytes`` of the rebuilt conversations, and ``conv_id, total`` of all.

    Conversation c begins with the first h turns of conversation c - c % 5 and goes on with its own
    after its first h, where h is crc32(c) % 9.
    """
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = lengths.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h.cast("bigint").alias("h"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("kept", F.least("h", F.coalesce("base_n", F.lit(0))))
    total = convs.select("conv_id", (F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    columns = ["role", "digest", "n_bytes"]
    # conversations x buckets of positions, so that a long one is not one join key
    bucket = F.expr(f"(position - 1) div {BUCKET}")
    spans = convs.select("conv_id", "h", "kept", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {BUCKET}"))).alias("bucket"))
    own = turns.withColumn("bucket", bucket).join(spans, ["conv_id", "bucket"]).where("position > h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("kept")).alias("depth"), *columns)
    heads = turns.where("position <= 8 and conv_id % 5 = 0").withColumnRenamed("conv_id", "base")
    first = heads.join(convs.select("base", "conv_id", "h"), "base").where("position <= h").select("conv_id", F.col("position").alias("depth"), *columns)
    return first.unionByName(own), total


def paths(turns: DataFrame, total: DataFrame) -> DataFrame:
    """``conv_id, depth, x, y, p, q, n_bytes, is_end``: each turn's node, its parent's, and whether its conversation ends there."""
    lane = lambda k: F.xxhash64(F.lit(k), "depth", "role", "digest")
    t = turns.select("conv_id", "depth", F.expr(f"(depth - 1) div {BUCKET}").alias("bucket"), lane(1).alias("a"), lane(2).alias("b"), "n_bytes")
    sums = t.groupBy("conv_id", "bucket").agg(F.bit_xor("a").alias("a0"), F.bit_xor("b").alias("b0"))
    before = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    sums = sums.select("conv_id", "bucket", *[F.coalesce(F.bit_xor(c).over(before), zero).alias(c) for c in ("a0", "b0")])
    sums = sums.join(total, "conv_id")
    upto = Window.partitionBy("conv_id", "bucket").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = t.select("*", F.bit_xor("a").over(upto).alias("x"), F.bit_xor("b").over(upto).alias("y")).join(sums, ["conv_id", "bucket"])
    run = run.select("conv_id", "depth", "a", "b", F.col("x").bitwiseXOR(F.col("a0")).alias("x"), F.col("y").bitwiseXOR(F.col("b0")).alias("y"), "n_bytes", (F.col("depth") == F.col("total")).alias("is_end"))
    return run.select("conv_id", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("a")).alias("p"), F.col("y").bitwiseXOR(F.col("b")).alias("q"), "n_bytes", "is_end")


class SpillingQueue:
    """Messages (leaves, children, saved) by key, smallest key first.

    Messages of one key are added up as they come.  Beyond ``most`` keys they are written as a
    sorted run to an unnamed file that goes with the task; ``take`` merges memory and runs.
    """

    def __init__(self, most: int = IN_MEMORY):
        self.most, self.sums, self.heap, self.runs = most, {}, [], []

    def push(self, key: tuple, message: tuple) -> None:
        if (held := self.sums.get(key)) is not None:
            self.sums[key] = tuple(a + b for a, b in zip(held, message))
            return
        if len(self.sums) >= self.most:
            self._spill()
        self.sums[key] = message
        heapq.heappush(self.heap, key)

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        for item in sorted(self.sums.items()):
            pickle.dump(item, file, protocol=5)
        file.seek(0)
        self.sums, self.heap = {}, []
        self._next(file)

    def _next(self, file) -> None:
        try:
            key, message = pickle.load(file)
        except EOFError:
            file.close()
            return
        heapq.heappush(self.runs, (key, id(file), message, file))

    def take(self, key: tuple) -> tuple:
        """The sum of the messages of ``key``, which must not be above the first one."""
        total = (0, 0, 0)
        if self.heap and self.heap[0] == key:
            heapq.heappop(self.heap)
            total = self.sums.pop(key)
        while self.runs and self.runs[0][0] == key:
            _, _, message, file = heapq.heappop(self.runs)
            total = tuple(a + b for a, b in zip(total, message))
            self._next(file)
        return total


def forwarded(rows, most: int = IN_MEMORY) -> Iterator[tuple]:
    """``depth, x, y, leaves, children, saved`` of every node of a shard, the root last.

    ``rows`` are ``depth, x, y, p, q, is_owner, leaves, saved`` by falling depth and key; rows of one
    node are neighbours.  The root has no row: it is what is left in the queue.
    """
    queue, node, sums = SpillingQueue(most), None, None

    def close():
        depth, x, y, p, q, owned = node
        leaves, children, saved = (a + b for a, b in zip(queue.take((-depth, x, y)), sums))
        queue.push((1 - depth, p, q), (leaves, int(owned), saved))
        return depth, x, y, leaves, children, saved

    for depth, x, y, p, q, is_owner, leaves, saved in rows:
        if node and node[:3] == (depth, x, y):
            node = (*node[:5], node[5] or is_owner)
            sums = (sums[0] + leaves, 0, sums[2] + saved)
            continue
        if node:
            yield close()
        node, sums = (depth, x, y, p, q, is_owner), (leaves, 0, saved)
    if node:
        yield close()
        yield (0, 0, 0, *queue.take((0, 0, 0)))


def _totals(path: DataFrame, nodes: DataFrame, n_shards: int) -> DataFrame:
    """``depth, x, y, leaves, n_children, saved`` summed over each node's subtree (children: of the node)."""
    shard = lambda c: F.pmod(F.xxhash64(c - c % 5), F.lit(n_shards)).cast("int").alias("shard")
    conv, nothing = F.col("conv_id"), F.lit(0).cast("bigint")
    passed = path.select(shard(conv), *KEY, *PARENT).groupBy("shard", *KEY, *PARENT).agg(F.lit(False).alias("is_owner"), nothing.alias("leaves"), nothing.alias("saved"))
    own = nodes.where("depth > 0").select(shard(conv), *KEY, *PARENT, F.lit(True).alias("is_owner"), "leaves", "saved")
    kept = [*KEY, *PARENT, "is_owner", "leaves", "saved"]
    rows = passed.unionByName(own).repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "x", "y").select("shard", *kept)
    schema = "depth bigint, x bigint, y bigint, leaves bigint, n_children bigint, saved bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for _, part in groupby(flat, key=lambda r: r[0]):
            for row in forwarded(r[1:] for r in part):
                out.append(row)
                if len(out) == ROWS:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return rows.mapInArrow(run, schema).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("leaves", "n_children", "saved")])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)


def _ends(path: DataFrame, total: DataFrame) -> DataFrame:
    """``depth, x, y, ends_sha256``: digest of the ids of the conversations that end at a node.

    Ids are gathered into chunks by their value, and the chunks of a node stream through one task
    in order, which holds a chunk at a time.
    """
    zero = F.lit(0).cast("bigint")
    ends = path.where("is_end").select("conv_id", *KEY).unionByName(total.where("total = 0").select("conv_id", *[zero.alias(k) for k in KEY]))
    ids = ends.groupBy(*KEY, F.expr(f"(conv_id - pmod(conv_id, {CHUNK})) div {CHUNK}").alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    rows = ids.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids")
    schema = "depth bigint, x bigint, y bigint, ends_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, []
        for b in batches:
            for *key, text in zip(*(c.to_pylist() for c in b.columns)):
                if key == node:
                    digest.update(b",")
                else:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256()
                digest.update(text.encode())
            if len(out) >= ROWS:
                yield _batch(out, schema)
                out = []
        if node:
            yield _batch([*out, (*node, digest.hexdigest())], schema)

    return rows.mapInArrow(run, schema)


def trie(conversations: DataFrame, n_shards: int | None = None) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Null role or text is empty.  Rows with a null ``conv_id`` belong to no conversation and are left
    out; repeated rows are turns of their own.  An empty table has no node, not even a root.  Other
    columns are not read.  Digests of 128 bits tell nodes apart.
    """
    turns = materialise(turns_of(conversations))
    told, total = rebuilt(turns)
    path = materialise(paths(told, total))
    totals_of = F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")
    zero = F.lit(0).cast("bigint")
    inner = path.groupBy(*KEY, *PARENT).agg(*totals_of, F.min("n_bytes").alias("n_bytes"), F.count_if("is_end").alias("n_ends"))
    root = total.agg(*totals_of, F.count_if(F.col("total") == 0).alias("n_ends")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in (*KEY, *PARENT)], "n_convs", "conv_id", zero.alias("n_bytes"), "n_ends")
    nodes = inner.unionByName(root).select(
        *KEY, *PARENT, "n_convs", "conv_id", (F.col("n_convs") == F.col("n_ends")).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    nodes = materialise(nodes)
    sums = _totals(path, nodes, n_shards or SHARDS * partitions(conversations))
    # a root without children has no row of totals: its own value is all
    own = nodes.withColumnsRenamed({"leaves": "own_leaves", "saved": "own_saved"})
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("p"), F.col("y").alias("q"), F.col("conv_id").alias("parent_conv_id"))
    wide = own.join(parents, ["depth", *PARENT], "left").join(sums, KEY, "left").join(_ends(path, total), KEY, "left")
    return wide.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        F.coalesce("leaves", "own_leaves").alias("n_leaves"),
        F.coalesce("saved", "own_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
