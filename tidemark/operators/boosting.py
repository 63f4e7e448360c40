"""Histogram gradient boosting: many ensembles in one set of passes.

Features are binned once, and training rows with the same bins become one cell: they share every
score, so their number, sum of targets, mean log target and squares about it are all that gradients,
Hessians and losses need.  A few features have a bounded number of cells, however many the rows.
Cells are packed into arrays, one per partition.  A pass sums gradient, Hessian and row count per
(ensemble, node, feature, bin) inside every partition and adds the partitions' sums up; only those
sums, whose size knows nothing of the rows, reach the driver, which picks the splits.  Trees grow
leaf by leaf, best gain first.  As the driver asks for the children of every leaf that might be split
next, a pass settles a whole level and the result is still that of one split at a time.  Ensembles
over different features or losses share every pass.

The loop has thousands of short passes over the same packed cells.  They run as an RDD of numpy
arrays, kept in memory with spill to disk and checkpointed every ``PER_CHECKPOINT`` rounds: planning
a query for each pass would cost more than the pass.  Scores of the cells change once per round.
Up to ``SMALL`` cells even an empty pass costs more than the sums; then the same loop runs in one task
per ensemble, over the same packed cells.  Where these fill a fair part of all combinations of bins,
they lie in an array with an axis per feature, of which every node is a box.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import VARIANCE_FLOOR, finite, floored
from ..sources.results import shared_folder

ROUNDS, LEAVES, RATE, BINS, MIN_ROWS, MIN_HESSIAN = 300, 31, 0.05, 254, 20, 1e-3
#: Exponents are held within this.
CLIP = 30.0
PER_CHECKPOINT = 50
SMALL = 250_000
#: Places of an array over all bins per cell up to which one task sums boxes of it.
DENSE = 12
#: Combinations of bins, times ensembles, over which a forecasting task adds trees up.
TABLE = 1_000_000
#: Cells whose scores a forecasting task remembers.
REMEMBERED = 1_000_000
LOSSES = ("log", "qlike")


@dataclass(frozen=True)
class Ensemble:
    """What one model is: its loss, its features, and the direction each must keep (+1, -1 or none)."""

    loss: str
    features: tuple[str, ...]
    monotone: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays: feature, last bin of the left child, children (a leaf is its own) and the value added."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return Forest([self]).scores(bins)


#: A number whose product with 2^k has another top six bits for every k.
DE_BRUIJN = np.uint64(0x03F79D71B4CB0A89)


class Forest:
    """Sum of the trees of an ensemble.

    A tree of up to 64 leaves is a table per feature: for every bin the set of leaves, as bits, that
    the splits on that feature leave open.  The sets of all features have one leaf in common.
    """

    CHUNK = 16_384

    def __init__(self, trees: list[Tree]):
        self.tables = [self._table(t) for t in trees]

    @staticmethod
    def _table(t: Tree):
        ends = [k for k in range(len(t.value)) if t.left[k] == k]
        if len(ends) > 64:
            return t
        under = np.zeros(len(t.value), np.uint64)
        under[ends] = np.uint64(1) << np.arange(len(ends), dtype=np.uint64)
        inner = [k for k in range(len(t.value)) if t.left[k] != k]
        for k in reversed(inner):  # children have larger numbers than their parent
            under[k] = under[t.left[k]] | under[t.right[k]]
        open_ = {}
        for k in inner:
            sets = open_.setdefault(int(t.feature[k]), np.full(256, under[0]))
            sets[: t.bin[k] + 1] &= ~under[t.right[k]]
            sets[t.bin[k] + 1 :] &= ~under[t.left[k]]
        values = np.zeros(64)
        values[(under[ends] * DE_BRUIJN) >> np.uint64(58)] = t.value[ends]
        return open_, values, float(t.value[0])

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for a in range(0, len(bins), self.CHUNK):
            part, sums = bins[a : a + self.CHUNK], out[a : a + self.CHUNK]
            column = [c.astype(np.intp) for c in part.T]
            for table in self.tables:
                if isinstance(table, Tree):
                    sums += self._walk(table, part)
                    continue
                open_, values, alone = table
                if not open_:
                    sums += alone
                    continue
                (f, sets), *rest = open_.items()
                leaf = sets.take(column[f])
                for f, sets in rest:
                    leaf &= sets.take(column[f])
                leaf *= DE_BRUIJN
                leaf >>= np.uint64(58)
                sums += values.take(leaf.view(np.intp))
        return out

    @staticmethod
    def _walk(t: Tree, bins: np.ndarray) -> np.ndarray:
        out, open_ = np.empty(len(bins)), [(0, np.arange(len(bins)))]
        while open_:
            node, rows = open_.pop()
            if t.left[node] == node:
                out[rows] = t.value[node]
                continue
            low = bins[:, t.feature[node]][rows] <= t.bin[node]
            open_ += [(t.left[node], rows[low]), (t.right[node], rows[~low])]
        return out


def _cut(box: tuple, axis: int, edge: int) -> list[tuple]:
    """The two parts of a box of bins, the first up to bin ``edge`` of an axis."""
    own = box[axis]
    return [(*box[:axis], part, *box[axis + 1 :]) for part in (slice(own.start, edge + 1), slice(edge + 1, own.stop))]


def _leaves(feature: np.ndarray, edge: np.ndarray, left: np.ndarray, right: np.ndarray, axis: np.ndarray, whole: tuple) -> Iterator[tuple[int, tuple]]:
    """Leaves of a tree and the box of bins each stands for."""
    open_ = [(0, whole)]
    while open_:
        node, box = open_.pop()
        if left[node] == node:
            yield node, box
        else:
            open_ += zip((left[node], right[node]), _cut(box, axis[feature[node]], int(edge[node])))


def _table(trees: list[Tree], shape: np.ndarray) -> np.ndarray:
    """Sum of the trees at every combination of bins."""
    order = np.argsort(shape, kind="stable")
    axis, out = np.argsort(order), np.zeros(shape[order])
    whole = tuple(slice(0, n) for n in out.shape)
    for t in trees:
        for node, box in _leaves(t.feature, t.bin, t.left, t.right, axis, whole):
            out[box] += t.value[node]
    return out.transpose(axis)


@dataclass
class Fitted:
    """Fitted ensembles: bin edges of all features, and per ensemble its start, trees, losses and gains."""

    features: tuple[str, ...]
    edges: list[np.ndarray]
    rate: float
    ensembles: dict[str, Ensemble]
    start: dict[str, float] = field(default_factory=dict)
    trees: dict[str, list[Tree]] = field(default_factory=dict)
    losses: dict[str, list[float]] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)
    gains: dict[str, dict[str, float]] = field(default_factory=dict)

    def residual_variance(self, name: str) -> float:
        """Population variance of log target less score over the training rows, of an ensemble on the log target."""
        return max(2.0 * self.losses[name][-1] - self.bias[name] ** 2, 0.0)

    def forecasts(self, df: DataFrame) -> DataFrame:
        """Adds ``raw``: the raw score (log variance) of every ensemble, a struct by name.

        Where all combinations of bins are few, a task adds the trees up over all of them and looks rows up.
        Else it scores each cell of bins once and remembers up to ``REMEMBERED`` of them.
        """
        edges, start, trees, names = self.edges, self.start, self.trees, list(self.ensembles)
        most, shape = REMEMBERED, np.array([len(e) + 2 for e in edges])
        few = len(names) * np.prod(shape.astype(float)) <= TABLE

        @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
        def raw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if few:
                tables = [start[n] + _table(trees[n], shape) for n in names]
                for x in frames:
                    at = tuple(binned([x.iloc[:, k].to_numpy(float) for k in range(x.shape[1])], edges).T)
                    yield pd.DataFrame({n: t[at] for n, t in zip(names, tables)})
                return
            forests = [Forest(trees[n]) for n in names]
            known, values = np.zeros(0, np.uint64), np.zeros((0, len(names)))
            score = lambda bins: np.stack([start[n] + f.scores(bins) for n, f in zip(names, forests)], axis=1)
            for x in frames:
                bins = binned([x.iloc[:, k].to_numpy(float) for k in range(x.shape[1])], edges)
                if bins.shape[1] > 8:
                    yield pd.DataFrame(score(bins), columns=names)
                    continue
                cells, first, back = np.unique(_codes(bins), return_index=True, return_inverse=True)
                new = ~np.isin(cells, known, assume_unique=True)
                if len(known) + new.sum() > most:
                    known, values, new = known[:0], values[:0], np.ones(len(cells), bool)
                if new.any():
                    known, values = np.concatenate([known, cells[new]]), np.concatenate([values, score(bins[first[new]])])
                    order = np.argsort(known)
                    known, values = known[order], values[order]
                yield pd.DataFrame(values[np.searchsorted(known, cells)][back.ravel()], columns=names)

        return df.withColumn("raw", raw(F.struct(*[F.col(f).cast("double").alias(f) for f in self.features])))


def _codes(bins: np.ndarray) -> np.ndarray:
    """Up to eight bins of a row as one number."""
    wide = np.zeros((len(bins), 8), np.uint8)
    wide[:, : bins.shape[1]] = bins
    return wide.view(np.uint64).ravel()


def binned(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Bins as bytes, rows by features: 0 for a missing value, else 1 + the number of edges below it."""
    out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
    for k, (x, e) in enumerate(zip(columns, edges)):
        out[:, k] = np.where(np.isfinite(x), np.searchsorted(e, x, "left") + 1, 0)
    return out


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of each feature's bins: all its values if they are few, else quantiles from a sketch."""
    shares = [k / bins for k in range(1, bins)]
    row = df.agg(*[F.percentile_approx(finite(F.col(f).cast("double")), shares, 10 * bins).alias(f"q{k}") for k, f in enumerate(features)]).collect()[0]
    return [np.unique(np.array(row[f"q{k}"] or [], float)) for k in range(len(features))]


def gradients(loss: str, target: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if loss == "log":
        return z - np.log(target), np.ones(len(z))
    ratio = target * np.exp(-np.clip(z, -CLIP, CLIP))
    return 1.0 - ratio, ratio


def loss_sum(loss: str, target: np.ndarray, z: np.ndarray) -> float:
    """Half the squared error of the log, or QLIKE (ratio - log ratio - 1)."""
    if loss == "log":
        return float(0.5 * ((z - np.log(target)) ** 2).sum())
    z = np.clip(z, -CLIP, CLIP)
    return float((target * np.exp(-z) - np.log(target) + z - 1.0).sum())


def _cell_sums(loss: str, facts: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, tuple[float, float]]:
    """What a histogram sums per cell beside its rows, and the sums over all rows of the loss and of score less log target.

    ``facts`` are rows, sum of targets, mean log and squares about it.
    """
    n, total, log, squares = facts
    off = z - log
    if loss == "log":
        w = n * off
        return w, (0.5 * (float(w @ off) + float(squares.sum())), float(w.sum()))
    held = np.clip(z, -CLIP, CLIP)
    ratio = total * np.exp(-held)
    return ratio, (float(ratio.sum()) + float(n @ (held - log - 1.0)), float(n @ off))


def _newton(loss: str, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian from sums per cell and rows, on the second axis."""
    w, n = sums[:, 0], sums[:, 1]
    return (w, n) if loss == "log" else (n - w, w)


class Growing:
    """One tree as it grows on the driver, from histograms of its nodes."""

    def __init__(self, loss: str, allowed: np.ndarray, monotone: np.ndarray, leaves: int, depth: float, min_rows: int, min_hessian: float):
        self.loss, self.allowed, self.monotone, self.most, self.deepest = loss, allowed, monotone, leaves, depth
        self.min_rows, self.min_hessian, self.level = min_rows, min_hessian, {0: 0}
        self.split: list[tuple[int, int, int, int, int]] = []  # asked for: node, feature, bin, left, right
        self.asked: dict[int, tuple[int, int]] = {}
        self.hist: dict[int, np.ndarray] = {}
        self.best: dict[int, tuple] = {}
        self.value: dict[int, float] = {}
        self.bounds: dict[int, tuple[float, float]] = {}
        self.done: list[int] = []
        self.leaves, self.next = [0], 1

    def learn(self, nodes: list[int], hists: np.ndarray, bounds: list[tuple[float, float]]) -> None:
        """Take the nodes' histograms (nodes x sums and rows x features x bins) and find the best split of each."""
        left = hists.cumsum(axis=3)
        total = left[:, :, :1, -1:]
        lo, hi = np.array(bounds).T[:, :, None, None]
        bounded = self.monotone.any()

        def side(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            g, h = _newton(self.loss, s)
            w = -g / np.maximum(h, 1e-300)
            if bounded:
                w = np.clip(w, lo, hi)
            return h, w, -(2.0 * g + h * w) * w

        right = total - left
        with np.errstate(all="ignore"):  # empty sides; they are not allowed below
            (hl, wl, sl), (hr, wr, sr), (ht, wt, st) = side(left), side(right), side(total)
            gain = sl + sr - st
        fine = (np.minimum(left[:, 1], right[:, 1]) >= self.min_rows) & (np.minimum(hl, hr) >= self.min_hessian)
        fine &= self.allowed[:, None]
        if bounded:
            fine &= self.monotone[:, None] * (wr - wl) >= 0
        fine &= np.array([self.level[k] < self.deepest for k in nodes])[:, None, None]
        gain = np.where(fine, gain, -np.inf)
        at = gain.reshape(len(nodes), -1).argmax(axis=1)
        for i, (k, (f, b)) in enumerate(zip(nodes, zip(*np.unravel_index(at, gain.shape[1:])))):
            self.hist[k], self.bounds[k] = hists[i], bounds[i]
            self.value[k] = float(wt[i, 0, 0]) if ht[i, 0, 0] > 0 else 0.0
            fewer = bool(left[i, 1, f, b] <= right[i, 1, f, b])
            self.best[k] = (float(gain[i, f, b]), int(f), int(b), float(wl[i, f, b]), float(wr[i, f, b]), fewer)

    def advance(self) -> list[tuple[int, int]]:
        """Split leaves, best first, as far as histograms are known; the (node, child with fewer rows) to sum next."""
        while len(self.leaves) < self.most:
            node = max(self.leaves, key=lambda k: (self.best[k][0], -k))
            if not self.best[node][0] > 1e-12:
                return []
            if node not in self.asked:
                room = self.most - len(self.leaves)
                open_ = sorted((k for k in self.leaves if k not in self.asked and self.best[k][0] > 1e-12), key=lambda k: -self.best[k][0])[:room]
                for k in open_:
                    _, f, b, *_ = self.best[k]
                    self.asked[k] = (self.next, self.next + 1)
                    self.split.append((k, f, b, *self.asked[k]))
                    self.next += 2
                return [(k, self.asked[k][0 if self.best[k][5] else 1]) for k in open_]
            self.leaves.remove(node)
            self.leaves += self.asked[node]
            self.done.append(node)
        return []

    def answered(self, nodes: list[int], hists: np.ndarray) -> None:
        """Histograms of the children with fewer rows; the others are the rest of their parents."""
        children, both, bounds = [], [], []
        for node, hist in zip(nodes, hists):
            a, b = self.asked[node]
            _, f, _, wl, wr, fewer = self.best[node]
            lo, hi = self.bounds[node]
            self.level[a] = self.level[b] = self.level[node] + 1
            middle, way = (wl + wr) / 2, self.monotone[f]
            rest = self.hist[node] - hist
            children += [a, b]
            both += [hist, rest] if fewer else [rest, hist]
            bounds += [(middle if way < 0 else lo, middle if way > 0 else hi), (middle if way > 0 else lo, middle if way < 0 else hi)]
        self.learn(children, np.stack(both), bounds)

    def tree(self, rate: float) -> tuple:
        """What the finished ``Tree`` is built from, nodes numbered anew; splits that were asked for in vain are left out."""
        of = {k: i for i, k in enumerate([0, *[c for n in self.done for c in self.asked[n]]])}
        n = len(of)
        feature, bins, value = np.zeros(n, np.int32), np.full(n, 255, np.int32), np.zeros(n)
        left, right, level = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
        for node in self.done:
            i, (a, b) = of[node], (of[c] for c in self.asked[node])
            feature[i], bins[i], left[i], right[i] = self.best[node][1], self.best[node][2], a, b
            level[[a, b]] = level[i] + 1
        for node in self.leaves:
            value[of[node]] = rate * self.value[node]
        return feature, bins, left, right, value, int(level.max())


class Placed:
    """Cells of one part by node, as one tree of one ensemble grows."""

    def __init__(self, part, kind: str, z: np.ndarray, width: int):
        self.bins, facts = part
        self.w, self.losses = _cell_sums(kind, facts, z)
        self.n, self.width, self.rows, self.split = facts[0], width, {0: np.arange(len(z))}, 0

    def follow(self, splits: list[tuple[int, int, int, int, int]]) -> None:
        for node, f, b, left, right in splits[self.split :]:
            rows = self.rows.pop(node)
            low = self.bins[:, f].take(rows) <= b
            self.rows[left], self.rows[right] = rows[low], rows[~low]
        self.split = len(splits)

    def histogram(self, node: int) -> np.ndarray:
        """Sums per (feature, bin), and rows."""
        rows = self.rows[node]
        w, n = self.w.take(rows), self.n.take(rows)
        out = np.empty((2, self.bins.shape[1], self.width))
        for f in range(self.bins.shape[1]):
            cell = self.bins[:, f].take(rows).astype(np.intp)
            out[0, f], out[1, f] = np.bincount(cell, w, self.width), np.bincount(cell, n, self.width)
        return out


def _answer(placed: list[Placed], splits: list, wanted: list) -> list:
    """Histograms of the wanted nodes per ensemble."""
    out = []
    for p, s, w in zip(placed, splits, wanted):
        if w:
            p.follow(s)
        out.append(np.stack([p.histogram(node) for node in w]) if w else 0)
    return out


def _sums(part, kinds: list[str], splits: list, wanted: list, width: int) -> list:
    """What one part (bins, facts, scores) adds: histograms of the wanted nodes per ensemble, losses and biases."""
    b, facts, z = part
    placed = [Placed((b, facts), kind, z[k], width) for k, kind in enumerate(kinds)]
    return [*_answer(placed, splits, wanted), np.array([p.losses for p in placed])]


def _moved(part, trees: list[tuple]):
    b, facts, z = part
    return b, facts, z + np.stack([Tree(*x).scores(b) for x in trees])


class Held:
    """Cells at hand; where they are is kept while a tree grows."""

    def __init__(self, part, kinds: list[str], width: int):
        self.part, self.kinds, self.width = part, kinds, width

    def ask(self, splits: list, wanted: list) -> list:
        b, facts, z = self.part
        if not any(splits):
            self.placed = [Placed((b, facts), kind, z[k], self.width) for k, kind in enumerate(self.kinds)]
            self.losses = np.array([p.losses for p in self.placed])
        return [*_answer(self.placed, splits, wanted), self.losses]

    def move(self, trees: list[tuple]) -> None:
        self.part = _moved(self.part, trees)


class Grid:
    """Cells at hand as an array with an axis per feature: a node is a box of it, and its histograms are plain sums of that box.

    No cell is looked up or moved as a tree grows.  Axes are in order of length, the longest last.
    """

    def __init__(self, part, kinds: list[str], width: int):
        bins, facts, z = part
        self.kinds, self.width = kinds, width
        shape = bins.max(axis=0).astype(np.intp) + 1
        axes = np.argsort(shape, kind="stable")
        self.axis, self.shape = np.argsort(axes), tuple(shape[axes])
        at = np.ravel_multi_index(tuple(bins[:, f].astype(np.intp) for f in axes), self.shape)
        order = np.argsort(at)
        self.at, self.facts, self.z = (np.ascontiguousarray(x[..., order]) for x in (at, facts, z))
        self.whole = tuple(slice(0, n) for n in self.shape)
        self.sums, self.painted = np.zeros((len(kinds), 2, *self.shape)), np.zeros(self.shape)
        for _, rows in self.sums:
            rows.ravel()[self.at] = self.facts[0]

    @staticmethod
    def room(bins: np.ndarray) -> float:
        """Places of the array that these cells would need."""
        return float(np.prod(bins.max(axis=0) + 1.0))

    def ask(self, splits: list, wanted: list) -> list:
        if not any(splits):
            self.boxes, self.split, losses = [{0: self.whole} for _ in self.kinds], [0] * len(self.kinds), []
            for (sums, _), kind, z in zip(self.sums, self.kinds, self.z):
                sums.ravel()[self.at], both = _cell_sums(kind, self.facts, z)
                losses.append(both)
            self.losses = np.array(losses)
        out = []
        for k, (asked, nodes) in enumerate(zip(splits, wanted)):
            boxes = self.boxes[k]
            for node, f, b, left, right in asked[self.split[k] :]:
                boxes[left], boxes[right] = _cut(boxes.pop(node), self.axis[f], int(b))
            self.split[k] = len(asked)
            out.append(np.stack([self._histogram(self.sums[k], boxes[node]) for node in nodes]) if nodes else 0)
        return [*out, self.losses]

    def move(self, trees: list[tuple]) -> None:
        steps = []
        for feature, edge, left, right, value, _ in trees:
            for node, box in _leaves(feature, edge, left, right, self.axis, self.whole):
                self.painted[box] = value[node]
            steps.append(self.painted.ravel().take(self.at))
        self.z = self.z + np.stack(steps)

    def _histogram(self, sums: np.ndarray, box: tuple) -> np.ndarray:
        """Sums per (feature, bin), and rows: the last axis' by adding up the others, then the same without it."""
        part, out = sums[:, *box], np.zeros((len(box), 2, self.width))
        for d in reversed(range(len(box))):
            margin = part
            for _ in range(d):
                margin = np.ones(margin.shape[-2]) @ margin
            out[d, :, box[d]] = margin
            part = part @ np.ones(part.shape[-1])
        return out[self.axis].swapaxes(0, 1)


class Passes:
    """Cells of an RDD: a question is a pass over it."""

    def __init__(self, data, mean: float, kinds: list[str], width: int):
        self.kinds, self.width, self.round, self.old = kinds, width, 0, data
        data = data.coalesce(data.context.defaultParallelism)
        self.state = data.map(lambda d: (*d, np.full((len(kinds), len(d[0])), mean))).persist(StorageLevel.MEMORY_AND_DISK)

    def ask(self, splits: list, wanted: list) -> list:
        kinds, width = self.kinds, self.width
        sums, add = self.state.map(lambda part: _sums(part, kinds, splits, wanted, width)), lambda a, b: [x + y for x, y in zip(a, b)]
        out = sums.reduce(add) if sums.getNumPartitions() <= 32 else sums.treeReduce(add)
        if self.old is not None:
            self.old = self.old.unpersist() and None
        return out

    def move(self, trees: list[tuple]) -> None:
        self.old, self.state = self.state, self.state.map(lambda part: _moved(part, trees)).persist(StorageLevel.MEMORY_AND_DISK)
        self.round += 1
        if self.round % PER_CHECKPOINT == 0:
            self.state.checkpoint()


def boost(rows: Held | Passes, n: int, kinds: list[str], allowed: list[np.ndarray], monotone: list[np.ndarray], rounds: int, leaves: int, depth: float, rate: float, min_rows: int, min_hessian: float):
    """Trees (as tuples), mean losses, gains by feature and last mean of score less log target of every ensemble, from ``n`` rows."""
    m = len(allowed)
    trees, losses, gains = [[] for _ in range(m)], [[] for _ in range(m)], np.zeros((m, len(allowed[0])))
    for r in range(rounds + 1):
        *hists, total = rows.ask([[]] * m, [[0] if r < rounds else []] * m)
        for k in range(m):
            losses[k].append(float(total[k, 0] / n))
        if r == rounds:
            break
        grown = [Growing(kinds[k], allowed[k], monotone[k], leaves, depth, max(min_rows, 1), min_hessian) for k in range(m)]
        for g, hist in zip(grown, hists):
            g.learn([0], hist, [(-np.inf, np.inf)])
        while any(wanted := [g.advance() for g in grown]):
            hists = rows.ask([g.split for g in grown], [[child for _, child in w] for w in wanted])
            for g, w, hist in zip(grown, wanted, hists):
                if w:
                    g.answered([node for node, _ in w], hist)
        new = [g.tree(rate) for g in grown]
        for k, g in enumerate(grown):
            trees[k].append(new[k])
            for node in g.done:
                gains[k, g.best[node][1]] += g.best[node][0]
        rows.move(new)
    return trees, losses, gains, total[:, 1] / n


def _checkpoint_folder(df: DataFrame) -> None:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))


def _packed(df: DataFrame, target: Column, features: tuple[str, ...], edges: list[np.ndarray]):
    """Cells of rows as an RDD of (bins, facts), one per partition that has any."""
    n = len(features)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = binned([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], edges)
            ends = pa.py_buffer((np.arange(len(bins) + 1, dtype=np.int32) * n).tobytes())
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(bins), [None, ends, pa.py_buffer(bins.tobytes())]), b.column(0)], ["b", "t"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, facts = [], []
        for b in batches:
            bins.append(b"".join(b.column(0).to_pylist()))
            facts.append(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:]]))
        if bins:
            yield pa.RecordBatch.from_pydict({"b": [b"".join(bins)], "f": [np.concatenate(facts, axis=1).tobytes()]})

    rows = df.select(floored(target, VARIANCE_FLOOR).cast("double").alias("t"), *[F.col(f).cast("double").alias(f) for f in features])
    log, count = F.log("t"), F.count(F.lit(1)).cast("double")
    cells = rows.mapInArrow(place, "b binary, t double").groupBy("b").agg(count.alias("n"), F.sum("t").alias("s"), F.avg(log).alias("l"), (count * F.var_pop(log)).alias("v"))
    return cells.mapInArrow(pack, "b binary, f binary").rdd.map(
        lambda r: (np.asfortranarray(np.frombuffer(r.b, np.uint8).reshape(-1, n)), np.frombuffer(r.f).reshape(4, -1)))


def fit(
    df: DataFrame, ensembles: dict[str, Ensemble], target: Column, training: Column, rounds: int = ROUNDS, leaves: int = LEAVES, rate: float = RATE,
    depth: float = float("inf"), bins: int = BINS, min_rows: int = MIN_ROWS, min_hessian: float = MIN_HESSIAN, edges: list[np.ndarray] | None = None,
) -> Fitted:
    """Boost every ensemble on the training rows with a target.

    A missing feature value lies below all others.  An ensemble starts from the mean log target;
    ``losses`` has the mean training loss before every round and after the last.  Leaf values and
    splits follow Newton steps without a penalty; a tree without a split of positive gain is one
    leaf.  Without training rows an error is raised.
    """
    features = tuple(sorted({f for e in ensembles.values() for f in e.features}))
    rows = df.where(training & finite(target).isNotNull())
    edges = bin_edges(rows, list(features), bins) if edges is None else edges
    fitted = Fitted(features, edges, rate, ensembles)
    names, width = list(ensembles), max(len(e) for e in edges) + 2
    kinds = [ensembles[n].loss for n in names]
    allowed = [np.array([f in ensembles[n].features for f in features]) for n in names]
    monotone = [np.array([ensembles[n].monotone.get(f, 0) for f in features]) for n in names]
    _checkpoint_folder(df)
    data = _packed(rows, target, features, edges).persist(StorageLevel.MEMORY_AND_DISK)
    cells, count, total = data.map(lambda d: np.array([len(d[0]), d[1][0].sum(), (d[1][0] * d[1][2]).sum()])).fold(np.zeros(3), np.add)
    if not count:
        raise ValueError("no training rows with a target")
    count, mean = int(count), float(total / count)
    limits = (rounds, leaves, depth, rate, min_rows, min_hessian)
    if cells <= SMALL:
        def alone(parts):
            for k, held in parts:
                held = list(held)
                b, facts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1)
                order = np.lexsort(b.T)
                part = (np.asfortranarray(b[order]), np.ascontiguousarray(facts[:, order]), np.full((1, len(b)), mean))
                rows = (Grid if Grid.room(b) <= DENSE * len(b) else Held)(part, kinds[k : k + 1], width)
                yield k, boost(rows, count, kinds[k : k + 1], allowed[k : k + 1], monotone[k : k + 1], *limits)

        every = range(len(names))
        got = dict(data.flatMap(lambda d: [(k, d) for k in every]).groupByKey(len(names), int).mapPartitions(alone).collect())
        trees, losses, gains, bias = [[got[k][i][0] for k in every] for i in range(4)]
    else:
        trees, losses, gains, bias = boost(Passes(data, mean, kinds, width), count, kinds, allowed, monotone, *limits)
    data.unpersist()
    for k, n in enumerate(names):
        fitted.start[n], fitted.trees[n], fitted.losses[n], fitted.bias[n] = mean, [Tree(*t) for t in trees[k]], losses[k], float(bias[k])
        fitted.gains[n] = {f: float(g) for f, g in zip(features, gains[k]) if f in ensembles[n].features}
    return fitted
