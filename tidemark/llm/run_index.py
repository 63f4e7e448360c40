"""Suffix-array dedup by run-length indexes.

Which 200-byte strings start at two places?  Every such string holds an anchor: the 32 bytes with
the smallest hash among its places.  Equal strings hold equal anchors at the same distance, so
only the surroundings of an anchor that occurs twice can repeat (``surroundings``: the anchor and
up to 168 bytes on both sides, all strings that hold it).

1. Blocks of documents send the hashes of anchors and surroundings to hash parts.  A part answers
   whether the whole surroundings occur twice (then every string in them is removed, done) and
   whether the anchor has other surroundings too (then one copy of each is compared).
2. Surroundings to compare go to the part of their anchor.  There, pieces of a document that
   overlap join, so every byte stands once; the text gets a run-length Burrows-Wheeler index
   with positions sampled at the ends of runs.  From those samples the match lengths of all
   positions stream in text order, and places that match 200 bytes elsewhere are marked.
3. An anchor with more than ``HOT`` different surroundings would make an index without bound.
   Its strings are counted by their own hashes, combined per block, which is exact and has no
   large group.
4. Blocks get their marks back and cut the documents.

Texts are shuffled once and the same shuffle serves every pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.blocks import SENT, blocked, table_bytes
from tidemark.llm.columns import factors, mix, pieces, text_bytes
from tidemark.sources.results import materialise

#: Bytes of a string that may not repeat, and of an anchor.
LENGTH, ANCHOR = 200, 32
SIDE = LENGTH - ANCHOR
AROUND = LENGTH + SIDE
#: Different surroundings of one anchor beyond which strings are counted one by one.
HOT = 2048
#: Bytes of text per index, about; bytes of text handled at once.
INDEX, STEP = 1 << 19, 1 << 20
MOVED = "block int, part int, kind int, a binary, b binary"
WHOLE, COMPARE, ONE_BY_ONE = 1, 2, 4
MARKS, SURROUNDINGS, STRINGS, PLACES, COUNTS = range(5)


class RunIndex:
    """A run-length compressed Burrows-Wheeler transform with positions sampled at run ends."""

    def __init__(self, text: np.ndarray) -> None:
        """``text``: small integers; equal separators are ordinary symbols here."""
        self.text, n = text.astype(np.uint16), len(text)
        order = self._suffixes(self.text)
        before = np.where(order > 0, self.text[order - 1].astype(np.int32), -1)
        self.head = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1]))) if n else np.zeros(0, np.int64)
        self.symbol, self.length = before[self.head], np.diff(np.append(self.head, n))
        self.first = order[self.head]  # text position sampled at the start of each run
        self.last = order[self.head + self.length - 1]  # and at its end

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by doubling; only suffixes that still tie are sorted again."""
        n = len(text)
        bits = max(1, n.bit_length())
        known, code = np.unique(text, return_inverse=True)
        width = int(len(known) + 1).bit_length()
        depth = max(1, (63 - bits) // width)
        key = np.zeros(n, np.uint64)
        code = code.astype(np.uint64) + np.uint64(1)
        for k in range(depth):
            key <<= np.uint64(width)
            if k < n:
                key[: n - k] |= code[k:]
        place = np.arange(n, dtype=np.uint64)
        packed = np.sort(key << np.uint64(bits) | place)
        mask = np.uint64((1 << bits) - 1)
        order = (packed & mask).astype(np.int64)
        top = packed >> np.uint64(bits)
        rank = np.zeros(n + 1, np.uint64)  # one more than the place of the group's first suffix; 0 beyond the end
        new = np.concatenate(([True], top[1:] != top[:-1])) if n else np.zeros(0, bool)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)).astype(np.uint64) + np.uint64(1)
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in the order, whole groups
        while len(tied):
            at = order[tied]
            group = rank[at]
            further = rank[np.minimum(at + depth, n)]
            if 3 * bits <= 63:
                packed = np.sort((group << np.uint64(bits) | further) << np.uint64(bits) | at.astype(np.uint64))
                at = (packed & mask).astype(np.int64)
                top = packed >> np.uint64(bits)
            else:
                by = np.lexsort((further, group))
                at, top = at[by], group[by] << np.uint64(bits) | further[by]
            order[tied] = at
            new = np.concatenate(([True], top[1:] != top[:-1]))
            rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))].astype(np.uint64) + np.uint64(1)
            tied = tied[~(new & np.append(new[1:], True))]
            depth *= 2
        return order

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes at ``a`` and ``b``."""
        n, out = len(self.text), np.zeros(len(a), np.int64)
        padded = np.concatenate((self.text, np.zeros(8, np.uint16)))
        words = np.ndarray((n + 4,), np.uint64, padded, strides=(2,))
        room = n - np.maximum(a, b)
        run = np.arange(len(a))
        for _ in range(128):
            if not len(run):
                break
            same = words[a[run] + out[run]] ^ words[b[run] + out[run]]
            part = np.where(same == 0, 4, np.where(same & np.uint64(0xFFFFFFFFFFFF) == 0, 3, np.where(same & np.uint64(0xFFFFFFFF) == 0, 2, np.where(same & np.uint64(0xFFFF) == 0, 1, 0))))
            out[run] += part
            run = run[(part == 4) & (out[run] < room[run])]
        for k in run:
            step = 1024
            while out[k] < room[k]:
                m = min(step, room[k] - out[k])
                x, y = a[k] + out[k], b[k] + out[k]
                differ = self.text[x : x + m] != self.text[y : y + m]
                if differ.any():
                    out[k] += int(differ.argmax())
                    break
                out[k] += m
                step *= 2
        return np.minimum(out, room)

    def match_lengths(self) -> np.ndarray:
        """For every text position, how long the suffix there matches one that starts elsewhere.

        The best partner is the neighbour before or after in suffix order.  Inside a run both
        step along with the text, so the length falls by one from the last sampled position.
        """
        n = len(self.text)
        if n < 2:
            return np.zeros(n, np.int64)
        shared = self.common(self.first[1:], self.last[:-1])
        best = np.zeros(n, np.int64)
        for at, edge, open_ in ((self.first[1:], self.first[0], shared), (self.last[:-1], self.last[-1], shared)):
            value, sampled = np.zeros(n, np.int64), np.zeros(n, np.int64)
            value[at] = open_ + at
            value[edge] = edge
            sampled[at] = at
            sampled[edge] = edge
            from_ = np.maximum.accumulate(sampled)
            best = np.maximum(best, value[from_] - np.arange(n))
        return best


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all strings within rows, and the row of each."""
    n = len(data) - ANCHOR + 1
    if n < LENGTH - ANCHOR + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.ndarray((len(data) - 7,), np.uint64, np.ascontiguousarray(data), strides=(1,))
    h = np.zeros(n, np.uint64)
    for k, f in zip(range(0, ANCHOR, 8), factors(4)):
        h += words[k : k + n] * f
    bits = np.uint64(max(1, n.bit_length()))
    least = mix(h) >> bits << bits | np.arange(n, dtype=np.uint64)
    wide = 1
    while 2 * wide <= SIDE + 1:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if SIDE + 1 > wide:
        least = np.minimum(least[: -(SIDE + 1 - wide)], least[SIDE + 1 - wide :])
    inside = np.zeros(len(least) + 1, np.int64)
    ends = np.minimum(offsets[1:] - LENGTH + 1, len(least))
    long = np.flatnonzero(ends > offsets[:-1])
    inside[offsets[:-1][long]] += 1
    inside[ends[long]] -= 1
    chosen = np.zeros(n, bool)
    chosen[(least[np.cumsum(inside[:-1]) > 0] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    return at, np.searchsorted(offsets, at, "right") - 1


def surroundings(data: np.ndarray, offsets: np.ndarray):
    """Anchors of a stretch of rows: row, place in the row, bytes left and right, bytes around, two hashes."""
    at, row = anchors(data, offsets)
    left = np.minimum(SIDE, at - offsets[row])
    right = np.minimum(SIDE, offsets[row + 1] - at - ANCHOR)
    padded = np.concatenate((np.zeros(SIDE, np.uint8), data, np.zeros(AROUND, np.uint8)))
    around = np.lib.stride_tricks.sliding_window_view(padded, AROUND)[at]
    cut = np.flatnonzero((left < SIDE) | (right < SIDE))
    if len(cut):
        k = np.arange(AROUND)
        around[cut] *= (k >= (SIDE - left[cut])[:, None]) & (k < (SIDE + ANCHOR + right[cut])[:, None])
    words = around.view(np.uint64)
    f = factors(AROUND // 8 + 4)
    anchor = mix((words[:, SIDE // 8 : SIDE // 8 + ANCHOR // 8] * f[-4:]).sum(1)) >> np.uint64(16)
    whole = mix(mix(words ^ f[: AROUND // 8]).sum(1) + mix((left * 256 + right).astype(np.uint64)))
    return row, at - offsets[row], left, right, around, anchor, whole


def of_block(table: pa.Table):
    """``surroundings`` of a whole block, row numbers of the block, without the bytes unless asked for."""
    data, offsets = table_bytes(table)
    for i, j in pieces(offsets, STEP):
        row, place, left, right, around, anchor, whole = surroundings(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield row + i, place, left, right, around, anchor, whole


def entries(table: pa.Table):
    """Distinct (anchor, surroundings) hashes of a block, sorted, how often each occurs, and where."""
    got = [(a, w) for *_, a, w in of_block(table)]
    anchor = np.concatenate([a for a, _ in got]) if got else np.zeros(0, np.uint64)
    whole = np.concatenate([w for _, w in got]) if got else np.zeros(0, np.uint64)
    order = np.lexsort((whole, anchor))
    a, w = anchor[order], whole[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (w[1:] != w[:-1]))) if len(a) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    where = np.empty(len(a), np.int64)
    where[order] = np.cumsum(new) - 1
    return a[head], w[head], np.diff(np.append(head, len(a))), where, order[head]


ENTRY = np.dtype([("anchor", "<u4"), ("whole", "<u8"), ("twice", "u1")])
PLACE = np.dtype([("row", "<u4"), ("place", "<u4"), ("left", "u1"), ("right", "u1"), ("anchor", "<u4")])
SPAN = np.dtype([("row", "<u4"), ("start", "<u4"), ("end", "<u4")])
STRING = np.dtype([("key", "<u8"), ("twice", "u1")])
AT = np.dtype([("key", "<u8"), ("row", "<u4"), ("start", "<u4")])


def part_of(keys48: np.ndarray, parts: int) -> np.ndarray:
    return ((keys48 >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def dealt(block: int, part: np.ndarray, kind: int, a: np.ndarray, b: np.ndarray | None, parts: int) -> list[tuple]:
    """Rows of ``MOVED`` with the slices of ``a`` (and ``b``) that go to each part."""
    order = np.argsort(part, kind="stable")
    a, part = a[order], part[order]
    b = b[order] if b is not None else None
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
    ends = np.append(cuts[1:], len(part)) if len(part) else []
    return [(block, int(part[s]), kind, a[s:e].tobytes(), b[s:e].tobytes() if b is not None else None) for s, e in zip(cuts, ends)]


def moved(rows: list[tuple]) -> pa.Table:
    block, part, kind, a, b = zip(*rows) if rows else ((),) * 5
    return pa.table({"block": pa.array(block, pa.int32()), "part": pa.array(part, pa.int32()), "kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def records(column, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def answer_entries(key, table):
    """What a block shall do with each of its surroundings, one byte each."""
    blobs = [np.frombuffer(x, ENTRY) for x in table.column("keys").to_pylist()]
    blocks = table.column("block").to_numpy()
    e = np.concatenate(blobs)
    block = np.repeat(blocks, [len(x) for x in blobs])
    order = np.lexsort((block, e["whole"], e["anchor"]))
    a, w, t = e["anchor"][order], e["whole"][order], e["twice"][order].astype(np.int64)
    same_anchor = np.concatenate(([False], a[1:] == a[:-1]))
    same_whole = same_anchor & np.concatenate(([False], w[1:] == w[:-1]))
    group, whole = np.cumsum(~same_anchor) - 1, np.cumsum(~same_whole) - 1
    count = np.bincount(whole, weights=t + 1)[whole]
    kinds = np.bincount(group, weights=~same_whole)[group]
    code = np.where(count >= 2, WHOLE, 0) | np.where((kinds >= 2) & ~same_whole, np.where(kinds > HOT, ONE_BY_ONE, COMPARE), 0)
    out = np.empty(len(e), np.uint8)
    out[order] = code
    ends = np.cumsum([0, *[len(x) for x in blobs]])
    return pa.table({"block": table.column("block"), "part": table.column("part"), "answer": pa.array([out[s:t].tobytes() for s, t in zip(ends[:-1], ends[1:])], pa.binary())})


def spans_of(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Disjoint ascending spans that cover the same bytes."""
    order = np.lexsort((start, row))
    row, start, end = row[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(row):
        return np.zeros(0, SPAN)
    far = row << 33
    reach = np.maximum.accumulate(far + end)
    new = np.concatenate(([True], (far + start)[1:] > reach[:-1]))
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(row)) - 1
    out = np.zeros(len(head), SPAN)
    out["row"], out["start"], out["end"] = row[head], start[head], reach[last] - far[last]
    return out


def repeats(places: np.ndarray, around: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings that start twice in some surroundings: index into ``places``' documents, and covered bytes."""
    start = places["place"].astype(np.int64) - places["left"]
    end = places["place"].astype(np.int64) + ANCHOR + places["right"]
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    fresh = np.concatenate(([True], doc[1:] != doc[:-1]))
    far = np.cumsum(fresh) << 33
    reach = np.maximum.accumulate(far + end) - far  # where the document's pieces so far end
    joined = ~fresh & np.concatenate(([False], start[1:] <= reach[:-1]))
    begin = np.where(joined, np.concatenate(([0], reach[:-1])), start)
    size = np.maximum(end - begin, 0)
    total = size + ~joined  # a separator before every new region
    at = np.cumsum(total) - size
    text = np.zeros(int(total.sum()), np.uint16)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    column = np.repeat(SIDE - (places["place"][order].astype(np.int64) - begin), size) + inner
    target = np.repeat(at, size) + inner
    text[target] = around[np.repeat(order, size), column].astype(np.uint16) + 1
    lengths = RunIndex(text).match_lengths()
    stop = np.append(np.flatnonzero(text == 0)[1:], len(text))
    region = np.cumsum(text == 0) - 1
    lengths = np.minimum(lengths, stop[region] - np.arange(len(text)))
    hits = np.flatnonzero((lengths >= LENGTH)[target])
    owner = np.repeat(np.arange(len(doc)), size)[hits]
    place = begin[owner] + inner[hits]
    return doc[owner], place, place + LENGTH


def compare(key, table):
    """Marks for the blocks whose surroundings met in this part."""
    kind = table.column("kind").to_numpy()
    rows = []
    strings = table.filter(pa.array(kind == STRINGS))
    if strings.num_rows:
        blobs = [np.frombuffer(x, STRING) for x in strings.column("a").to_pylist()]
        e = np.concatenate(blobs)
        keys, back = np.unique(e["key"], return_inverse=True)
        twice = np.bincount(back, weights=e["twice"].astype(np.int64) + 1)[back] >= 2
        ends = np.cumsum([0, *[len(x) for x in blobs]])
        rows += [(b, -1, COUNTS, e["key"][s:t][twice[s:t]].tobytes(), None) for b, s, t in zip(strings.column("block").to_pylist(), ends[:-1], ends[1:])]
    table = table.filter(pa.array(kind == SURROUNDINGS))
    if table.num_rows:
        blobs = [np.frombuffer(x, PLACE) for x in table.column("a").to_pylist()]
        places = np.concatenate(blobs)
        block = np.repeat(table.column("block").to_numpy(), [len(x) for x in blobs]).astype(np.int64)
        around = np.frombuffer(b"".join(table.column("b").to_pylist()), np.uint8).reshape(-1, AROUND)
        by = np.argsort(places["anchor"], kind="stable")
        head = np.flatnonzero(np.concatenate(([True], np.diff(places["anchor"][by].astype(np.int64)) != 0)))
        step = max(1, INDEX // AROUND)
        found, s = [], 0
        while s < len(by):  # whole anchors, about INDEX bytes
            e = int(np.searchsorted(head, s + step, "right")) - 1
            e = int(head[e]) if e >= 0 and head[e] > s else int(np.append(head, len(by))[np.searchsorted(head, s, "right")])
            e = len(by) if s + step >= len(by) else e
            take = by[s:e]
            doc = block[take] << 32 | places["row"][take]
            found.append(repeats(places[take], around[take], doc))
            s = e
        doc, start, end = (np.concatenate([f[k] for f in found]) for k in range(3))
        for b in np.unique(doc >> 32):
            of = (doc >> 32) == b
            rows.append((int(b), -1, MARKS, spans_of(doc[of] & 0xFFFFFFFF, start[of], end[of]).tobytes(), None))
    return moved(rows)


def repeated_spans(docs: DataFrame, rest: list[str] = (), as_text: bool = False) -> DataFrame:
    """``doc_id, rest, n_bytes, spans, kept`` of every document row.

    ``spans`` are the maximal runs of bytes (start, end) covered by a 200-byte string that also
    starts anywhere else in the corpus, in the same document too; ``kept`` is what remains.
    Null and empty texts have no bytes; rows that repeat an id or a text are documents of their
    own; ``rest`` names columns to carry along in a struct.  ``as_text`` gives ``kept`` as text,
    without characters that have lost some of their bytes.
    """
    b = blocked(docs, part=2 << 20, rest=list(rest))
    parts = b.parts

    def tell(block, table):
        a, w, n, _, _ = entries(table)
        e = np.zeros(len(a), ENTRY)
        e["anchor"], e["whole"], e["twice"] = a & np.uint64(0xFFFFFFFF), w, n > 1
        rows = dealt(block, part_of(a, parts), MARKS, e, None, parts)
        return pa.table({
            "part": pa.array([r[1] for r in rows], pa.int32()), "block": pa.array([r[0] for r in rows], pa.int32()),
            "keys": pa.array([r[3] for r in rows], pa.binary()), "extra": pa.array([None] * len(rows), pa.binary()),
        })

    def sort_out(block, table, answers):
        rows = answers.sort_by("part")
        code = np.frombuffer(b"".join(rows.column("answer").to_pylist()), np.uint8)
        _, _, _, where, chosen = entries(table)
        codes = code[where] if len(where) else np.zeros(0, np.uint8)
        owner = np.zeros(len(where), bool)
        owner[chosen] = True
        marks, out, seen, strings = [], [], 0, []
        for row, place, left, right, around, anchor, _ in of_block(table):
            c, own = codes[seen : seen + len(row)], owner[seen : seen + len(row)]
            seen += len(row)
            whole = (c & WHOLE > 0) & (left + right >= SIDE)
            marks.append(spans_of(row[whole], (place - left)[whole], (place + ANCHOR + right)[whole]))
            near = (c & COMPARE > 0) & own & (left + right >= SIDE)
            p = np.zeros(near.sum(), PLACE)
            p["row"], p["place"], p["left"], p["right"], p["anchor"] = row[near], place[near], left[near], right[near], anchor[near] & np.uint64(0xFFFFFFFF)
            out += dealt(block, part_of(anchor[near], parts), SURROUNDINGS, p, around[near], parts)
            hot = np.flatnonzero((c & ONE_BY_ONE > 0) & own & (left + right >= SIDE))
            for k in range(0, len(hot), 1024):
                strings.append(strings_of(row, place, left, right, around, hot[k : k + 1024]))
        out.append((block, -1, MARKS, np.concatenate(marks).tobytes() if marks else b"", None))
        if strings:
            s = np.unique(np.concatenate(strings))
            keys, n = np.unique(s["key"], return_counts=True)
            told = np.zeros(len(keys), STRING)
            told["key"], told["twice"] = keys, n > 1
            out += dealt(block, part_of(keys >> np.uint64(16), parts), STRINGS, told, None, parts)
            out.append((block, -1, PLACES, s.tobytes(), None))
        return moved(out)

    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), *([b.rows.schema["rest"]] if rest else []), T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
    ])

    def cut(block, table, told):
        if not table.num_rows:
            return pa.table({f.name: [] for f in schema}).cast(_arrow(schema))
        data, offsets = table_bytes(table)
        kind = told.column("kind").to_numpy()
        spans = [records(told.filter(pa.array(kind == MARKS)).column("a"), SPAN)]
        placed = records(told.filter(pa.array(kind == PLACES)).column("a"), AT)
        if len(placed):
            again = placed[np.isin(placed["key"], records(told.filter(pa.array(kind == COUNTS)).column("a"), np.dtype("<u8")))]
            more = np.zeros(len(again), SPAN)
            more["row"], more["start"], more["end"] = again["row"], again["start"], again["start"] + LENGTH
            spans.append(more)
        every = np.concatenate(spans)
        s = spans_of(every["row"], every["start"], every["end"])
        drop = np.zeros(len(data) + 1, np.int8)
        base = offsets[s["row"].astype(np.int64)]
        drop[base + s["start"]] += 1
        drop[base + s["end"]] -= 1
        keep = np.cumsum(drop[:-1], dtype=np.int8) == 0
        left = np.concatenate(([0], np.cumsum(keep)))[offsets]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[keep])]).cast(pa.binary())
        if as_text:
            kept = pa.array([k.decode(errors="ignore") for k in kept.to_pylist()], pa.string())
        bounds = np.searchsorted(s["row"], np.arange(len(offsets))).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(s["start"].astype(np.int64)), pa.array(s["end"].astype(np.int64))], names=["start", "end"])
        return pa.table([
            table.column("doc_id"), *([table.column("rest")] if rest else []), pa.array(np.diff(offsets), pa.int64()),
            pa.ListArray.from_arrays(pa.array(bounds), pairs), kept,
        ], names=[f.name for f in schema])

    asked = b.map(tell, SENT)
    answers = asked.groupBy("part").applyInArrow(lambda key, table: answer_entries(key, table), "block int, part int, answer binary")
    stage = materialise(b.join(answers, sort_out, MOVED))
    met = stage.where("part >= 0").groupBy("part").applyInArrow(lambda key, table: compare(key, table), MOVED)
    return b.join(stage.where("part < 0").unionByName(met), cut, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def strings_of(row, place, left, right, around, which) -> np.ndarray:
    """Hash and place of every string that holds the anchors at ``which``."""
    n = SIDE + 1
    starts = np.arange(n)
    view = np.lib.stride_tricks.sliding_window_view(around[which], LENGTH, axis=1)
    f = factors(LENGTH // 8)
    h = np.zeros((len(which), n), np.uint64)
    for k in range(LENGTH // 8):
        word = np.ascontiguousarray(view[:, :, 8 * k : 8 * k + 8]).view(np.uint64)[:, :, 0]
        h += mix(word ^ f[k])
    ok = (starts >= (SIDE - left[which])[:, None]) & (starts <= (right[which])[:, None])
    out = np.zeros(int(ok.sum()), AT)
    out["key"] = mix(h[ok])
    out["row"] = np.broadcast_to(row[which][:, None], ok.shape)[ok]
    out["start"] = ((place[which] - SIDE)[:, None] + starts)[ok]
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated bytes cut out, columns as given and ``n_chars`` counted anew.

    A character that loses some of its bytes goes with them; documents that lose all their text
    stay, empty.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = repeated_spans(docs, rest, as_text=True)
    of = {"doc_id": F.col("doc_id"), "text": F.col("kept")} | {c: F.col("rest").getField(c) for c in rest}
    if "n_chars" in of:
        of["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[of[c].alias(c) for c in docs.columns])


def report(found: DataFrame) -> DataFrame:
    """Digest columns of ``repeated_spans``."""
    return found.select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
