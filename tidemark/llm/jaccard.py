"""N-gram Jaccard join of whole documents by grouped prefixes.

Shingles are ordered by the number of documents that hold them (rarest first), counted over all
documents in packed blocks.  A shingle that nobody else holds can join nothing, so a document
with too many of those has no partner and leaves at once; the rest are cut to their prefixes.
Equal sets become one node, nodes with the same prefix and size one group, and only groups that
share a prefix shingle meet.  Group pairs are filtered by size, then expanded to members, and
members are verified on their whole sets.

Groups that share prefix shingles form clusters, and tasks work cluster by cluster, so a set moves
once and no pair becomes a row.  Only pairs in different components are compared, the most central
nodes first, which joins dense groups of copies in nearly linear work; a cluster too large for a
task is compared in blocks.  Components are labels in a table, lowered along links; nothing is
collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.blocks import COUNTED, Blocked, answered, blocked, packed, send, table_bytes, total_by_part, unpacked
from tidemark.llm.columns import LOWER, byte_table, mix, pieces, run_hashes, word_runs
from tidemark.sources.results import materialise

#: Words of a shingle, and the least Jaccard similarity in percent.
SHINGLE, PERCENT = 5, 75
#: Bits of a shingle's hash.  Counts only order shingles and find those held once: one count for
#: two shingles loses no pair.
BITS = 48
#: Rows that leave are sent to every task up to this number (16 bytes each), beyond it they are shuffled.
MOST_BROADCAST = 1_000_000
#: Nodes and bytes of sets that one task compares, pivots of a larger cluster, and nodes of a left block.
MOST_NODES, MOST_SET_BYTES, PIVOTS, LEFT = 4096, 8 << 20, 64, 512
MARK = "__text_mark"
#: Words are runs of anything but ASCII white space.
WORD = ~byte_table([(0x09, 0x0D), (0x20, 0x20)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after the other, and the rows' bounds."""
    parts, sizes = [], []
    for i, j in pieces(offsets, 1 << 20):
        for k in range(i, j, 60_000):
            part, n = _sets(data[offsets[k] : offsets[min(j, k + 60_000)]], offsets[k : min(j, k + 60_000) + 1] - offsets[k])
            parts.append(part)
            sizes.append(n)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1, np.int64)


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, rows = LOWER[data], len(offsets) - 1
    starts, lengths, row = word_runs(low, offsets, WORD)
    words = run_hashes(low, starts, lengths)
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    size = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(n.dtype))
    owner = np.repeat(np.arange(rows), size)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    length = np.minimum(n[owner], SHINGLE)
    padded = np.concatenate((words, np.zeros(SHINGLE, np.uint64)))
    h = length.astype(np.uint64)
    for k in range(SHINGLE):
        h = mix(h + np.where(length > k, padded[at + k], np.uint64(0)) * np.uint64(2 * k + 1))
    packed = np.sort(owner.astype(np.uint64) << np.uint64(BITS) | h >> np.uint64(64 - BITS))
    packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))] if len(packed) else packed
    return packed & np.uint64((1 << BITS) - 1), np.bincount((packed >> np.uint64(BITS)).astype(np.int64), minlength=rows)


def prefixed(b: Blocked, id_type: T.DataType) -> DataFrame:
    """For each document its set's size and key; for one document per key and block also its prefix and set.

    ``own`` is the number of shingles that no other document holds.  Key, prefix and set are null
    where no other document can be similar.
    """
    parts = b.parts
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("n", T.LongType()), T.StructField("own", T.LongType()), T.StructField("key", T.StringType()),
        T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("shingles", T.BinaryType()), T.StructField("mark", T.LongType()),
    ])

    def counted(block: int, table: pa.Table) -> pa.Table:
        distinct, counts = np.unique(shingle_sets(*table_bytes(table))[0], return_counts=True)
        return send(block, distinct, counts, parts, BITS)

    def cut(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        flat, bounds = shingle_sets(*table_bytes(table))
        distinct, back = np.unique(flat, return_inverse=True)
        held = answered(answers)[back] if len(distinct) else np.zeros(0, np.int64)
        n = np.diff(bounds)
        shared = np.concatenate(([0], np.cumsum(held > 1)))
        own = n - (shared[bounds[1:]] - shared[bounds[:-1]])
        length = n + (-PERCENT * n) // 100 + 1
        keys, prefixes, sets, seen = [], [], [], set()
        for k in range(len(n)):
            if n[k] == 0 or own[k] >= length[k]:
                keys.append(None), prefixes.append(None), sets.append(None)
                continue
            mine, count = flat[bounds[k] : bounds[k + 1]], held[bounds[k] : bounds[k + 1]]
            key = f"{int(n[k]):08x}{int(mix(mine).sum()):016x}{int(mix(mine ^ np.uint64(0x5555)).sum()):016x}"
            keys.append(key)
            if key in seen:
                prefixes.append(None), sets.append(None)
                continue
            seen.add(key)
            mine_shared = count > 1
            by = np.lexsort((mine[mine_shared], count[mine_shared]))[: length[k] - own[k]]
            prefixes.append(mine[mine_shared][by].astype(np.int64).tolist())
            sets.append(packed(mine, BITS // 8).tobytes())
        return pa.table({
            "doc_id": table.column("doc_id"), "n": pa.array(n, pa.int64()), "own": pa.array(own, pa.int64()), "key": pa.array(keys, pa.string()),
            "prefix": pa.array(prefixes, pa.list_(pa.int64())), "shingles": pa.array(sets, pa.binary()),
            "mark": table.column("mark"),
        })

    return b.join(total_by_part(b.map(counted, COUNTED), parts, BITS), cut, schema)


def forest(keys, grp, n, shared, prefixes, sets, label, source) -> tuple[list[str], list[str]]:
    """Links that join all similar members among those at hand, from ``source`` members to others.

    Groups are paired if they share a prefix shingle; their members if sizes, and the shingles that
    anybody else holds, allow the similarity; such pairs are verified on whole sets.  Members that
    are in one component (``label``) already, or have come into one here, are not compared.
    """
    m = len(keys)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
    _, number = np.unique(flat, return_inverse=True)
    holders, ends = owner[np.argsort(number, kind="stable")], np.append(0, np.cumsum(np.bincount(number)))
    first = np.append(0, np.cumsum(n))
    _, member, gid = np.unique(grp, return_index=True, return_inverse=True)
    at: dict[int, list[int]] = {}
    for g, k in enumerate(member):
        for token in prefixes[k]:
            at.setdefault(token, []).append(g)
    near: dict[int, np.ndarray] = {}
    comp, left, right = label.copy(), [], []
    for k in np.lexsort((keys, -shared / n)):
        if not source[k]:
            continue
        ok = (comp != comp[k]) & (100 * np.minimum(n, n[k]) >= PERCENT * np.maximum(n, n[k])) & ((100 + PERCENT) * np.minimum(shared, shared[k]) >= PERCENT * (n + n[k]))
        if not ok.any():
            continue
        g = gid[k]
        if g not in near:
            near[g] = np.zeros(len(member), bool)
            near[g][[g, *{x for token in prefixes[member[g]] for x in at[token]}]] = True
        ok &= near[g][gid]
        if not ok.any():
            continue
        mine = number[first[k] : first[k + 1]]
        both = np.bincount(np.concatenate([holders[ends[t] : ends[t + 1]] for t in mine]), minlength=m)
        hit = np.flatnonzero(ok & (100 * both >= PERCENT * (n + n[k] - both)))
        met, one = np.unique(comp[hit], return_index=True)
        if len(met):
            left += [keys[k]] * len(met)
            right += [keys[x] for x in hit[one]]
            comp[np.isin(comp, met)] = comp[k]
    return left, right


def linked(rows: DataFrame, by: list[str]) -> DataFrame:
    """``forest`` of every group of rows ``key, grp, n, own, prefix, shingles, label, source``."""

    def run(_, table):
        if table.num_rows < 2:
            return pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string())})
        table = table.sort_by("key")
        of = lambda c: table.column(c).to_numpy()
        sets = [unpacked(np.frombuffer(x, np.uint8), BITS // 8) for x in table.column("shingles").to_pylist()]
        label = np.unique(of("label"), return_inverse=True)[1]
        a, b = forest(of("key"), of("grp"), of("n"), of("n") - of("own"), table.column("prefix").to_pylist(), sets, label, of("source"))
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return rows.groupBy(*by).applyInArrow(run, "a string, b string")


def components(links: DataFrame) -> DataFrame:
    """``key, component``: a key of its own component, the same for all of it, for every key with a link.

    Each round hooks every key to its smallest neighbour, shortens the hooks and replaces the keys
    of all links by their hooks.  Links within a key go, so what is left at least halves each
    round, whatever the links' shape.
    """
    edges = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    hooks = []
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("low")).select("key", F.least("key", "low").alias("to"))
        hook = materialise(hook.join(hook.select(F.col("key").alias("to"), F.col("to").alias("next")), "to").select("key", F.col("next").alias("to")))
        hooks.append(hook)
        ends = [hook.select(F.col("key").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab"]
        moved = edges.join(ends[0], "a").join(ends[1], "b").where("to_a <> to_b")
        edges = materialise(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if not hooks:
        return links.select(F.col("a").alias("key"), F.col("b").alias("component")).limit(0)
    label = hooks[0].withColumnRenamed("to", "component")
    for hook in hooks[1:]:
        label = label.join(hook.withColumnRenamed("key", "component"), "component", "left").select("key", F.coalesce("to", "component").alias("component"))
    return materialise(label)


def all_links(nodes: DataFrame) -> DataFrame:
    """Links ``a, b`` between nodes, enough to join each component.

    Groups that share prefix shingles, directly or through others, make a cluster, and no link
    leaves it.  A cluster is one task's work up to ``MOST_NODES`` and ``MOST_SET_BYTES``.  A
    larger one is cut into chunks that each also hold ``PIVOTS`` central nodes of it (of a random
    sixteen times as many, those with the fewest shingles of their own), which joins nearly all that can be joined; then every node outside
    the cluster's largest component meets every node of the cluster, in blocks.
    """
    groups = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.first("prefix").alias("prefix"))
    seats = groups.select("grp", F.explode("prefix").alias("token"))
    heads = seats.groupBy("token").agg(F.min("grp").alias("a"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    tied = components(seats.join(heads.select("token", "a"), "token").select("a", F.col("grp").alias("b")).where("a <> b").distinct())
    placed = groups.select("grp", "members").join(tied.select(F.col("key").alias("grp"), F.col("component").alias("cluster")), "grp", "left")
    placed = placed.where("cluster is not null or members > 1").select("grp", F.coalesce("cluster", "grp").alias("cluster"), "members")
    members = nodes.join(placed.select("grp", "cluster"), "grp")
    sizes = materialise(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length("shingles")).cast("long").alias("bytes")))
    pieces_of = lambda most: F.greatest(F.ceil(F.col("size") / most), F.ceil(F.col("bytes") / MOST_SET_BYTES)).cast("int")
    chunks = sizes.select("cluster", "size", pieces_of(MOST_NODES).alias("chunks"))
    members = members.join(chunks, "cluster").withColumns({"label": F.col("key"), "source": F.lit(True)})
    part = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    small = members.where("chunks = 1")
    if not chunks.where("chunks > 1").limit(1).count():
        return linked(small, ["cluster"])
    large = materialise(members.where("chunks > 1"))
    some = large.select("cluster", "key", "size", (F.col("own") / F.col("n")).alias("far")).where(F.expr(f"pmod(xxhash64(key, 7), greatest(1, size div {16 * PIVOTS})) = 0"))
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy("far", "key"))
    central = large.join(some.withColumn("nth", nth).where(F.col("nth") <= PIVOTS).select("key"), "key")
    pivots = central.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where(F.col("chunk") != part("chunks"))
    near = materialise(linked(small, ["cluster"]).unionByName(linked(large.withColumn("chunk", part("chunks")).unionByName(pivots), ["cluster", "chunk"])))
    found = components(near)
    now = large.drop("label").join(found.select("key", F.col("component").alias("label")), "key", "left").withColumn("label", F.coalesce("label", "key"))
    share = now.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"))
    major = share.groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.sum("c").alias("all"), F.max("c").alias("most"))
    major = major.select("cluster", "major", F.ceil((F.col("all") - F.col("most")) / LEFT).cast("int").alias("lefts")).where("lefts > 0")
    now = now.join(major, "cluster")
    left = now.where("label <> major").withColumns({"l": part("lefts"), "r": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))})
    right = now.withColumns({"r": part("chunks"), "l": F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)), "source": F.lit(False)})
    right = right.where((F.col("label") == F.col("major")) | (part("lefts") != F.col("l")))
    return near.unionByName(linked(left.unionByName(right), ["cluster", "l", "r"]))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The documents with the smallest id of their component, columns as given.

    A row leaves if its component has a smaller id; of rows that repeat an id and its text one
    stays, and of rows with a null id in one component one.  Documents without words stay.
    """
    found = join(docs, mark=True)
    of = Window.partitionBy(F.coalesce("key", F.concat_ws(":", "mark", "doc_id")), "doc_id").orderBy("mark")
    gone = found.where("not (doc_id <=> component_id)").select("doc_id", "mark").distinct()
    twice = found.where("doc_id <=> component_id").withColumn("nth", F.row_number().over(of)).where("nth > 1").select("doc_id", "mark").distinct()
    gone, twice = materialise(gone), materialise(twice)
    small = gone.count() <= MOST_BROADCAST
    left = docs.withColumn(MARK, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    gone = gone.select(F.col("doc_id").alias("__gone_id"), F.col("mark").alias("__gone_mark"))
    left = left.join(F.broadcast(gone) if small else gone, F.col("doc_id").eqNullSafe(F.col("__gone_id")) & (F.col(MARK) == F.col("__gone_mark")), "left_anti")
    if twice.limit(1).count():
        left = left.dropDuplicates(["doc_id", MARK])
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def join(docs: DataFrame, mark: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of every document row.

    The component is named by its smallest ``doc_id``; ``n_links`` counts the verified links of
    the document's set that were needed to join its component.  Documents without words have no
    shingles and stand alone.  Rows that repeat an id are judged by their own texts; a null id is
    never a component's name unless nothing else is.  ``mark`` adds the set's key and the text's
    hash, by which a row can be found again.
    """
    rows = materialise(prefixed(blocked(docs), docs.schema["doc_id"].dataType))
    grp = F.sha1(F.concat_ws(",", F.col("n").cast("string"), F.array_join(F.col("prefix").cast("array<string>"), ",")))
    nodes = materialise(rows.where("shingles is not null").dropDuplicates(["key"]).select("key", grp.alias("grp"), "n", "own", "prefix", "shingles"))
    links = materialise(all_links(nodes))
    label = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    known = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    placed = known.join(label, "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component").join(degree, "key", "left").select("key", "component_id", "n_links")
    return rows.join(named, "key", "left").select(
        *(["key", "mark"] if mark else []), "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
