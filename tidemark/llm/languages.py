"""Language ID by words first and shorter and shorter character n-grams for unseen words.

A model holds the log frequencies, per language, of the words of a bounded training sample and of
their character n-grams (a word begins and ends with a mark).  A known word adds its log frequency
in each language.  At each place of an unseen word the longest known n-gram speaks, from
``LONGEST`` characters down to one, and the word adds the mean of its places.  Models are bounded
by the sample, so documents are judged where they are read, without a shuffle.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.columns import factors, give_back, mix, pieces, run_hashes, text_bytes, word_runs

#: Bounds of the training sample: rows (dealt evenly among languages) and bytes of their texts.
MOST_ROWS, MOST_BYTES = 12_000, 24 << 20
LONGEST, SMOOTHING, SEED = 4, 0.1, 13
#: Slices of a language's rows that are ranked apart before the sample is taken.
SLICES = 64
#: Bytes of text handled at once.
STEP = 1 << 20
#: Characters from here on are letters without case (ideographs) up to the next bound.
PLANE, IDEOGRAPHS = 0x20000, 0x323B0
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """The quarter of the documents that is never learned."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


@cache
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: whether it is a letter, a letter or mark, and its lower case."""
    letter, part, lower = np.zeros(0x110000, bool), np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for c in range(PLANE):
        kind = unicodedata.category(chr(c))[0]
        letter[c], part[c] = kind == "L", kind in "LM"
        if kind == "L" and len(small := chr(c).lower()) == 1:
            lower[c] = ord(small)
    letter[PLANE:IDEOGRAPHS] = part[PLANE:IDEOGRAPHS] = True
    return letter, part, lower


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows and their offsets; broken sequences give some code point."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    wide = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
    a, b, c, d = wide[at], *(wide[at + k] & 0x3F for k in (1, 2, 3))
    out = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 0x1F) << 6 | b, np.where(a < 0xF0, (a & 0x0F) << 12 | b << 6 | c, (a & 0x07) << 18 | b << 12 | c << 6 | d)))
    return np.minimum(out, 0x10FFFF), np.searchsorted(at, offsets)


class Words:
    """The words of some texts: lower-cased runs of letters and marks that hold a letter."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        letter, part, lower = characters()
        points, bounds = code_points(data, offsets)
        starts, lengths, row = word_runs(points, bounds, part)
        letters = np.concatenate(([0], np.cumsum(letter[points])))
        fine = letters[starts + lengths] > letters[starts]
        self.points, self.starts, self.lengths, self.row = lower[points], starts[fine], lengths[fine], row[fine]
        self.hashes = run_hashes(self.points, self.starts, self.lengths)

    def grams(self, which: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Of the words ``which``, each between marks: per length 1, 2, ... the hash of the n-gram at
        every place (0 where the word ends before), the word of the place, and the word's places."""
        n = self.lengths[which] + 2
        first = np.concatenate(([0], np.cumsum(n)))
        word = np.repeat(np.arange(len(which)), n)
        inside = np.arange(first[-1]) - first[:-1][word]
        marked = np.full(first[-1], 0x20, np.uint64)
        real = (inside > 0) & (inside < n[word] - 1)
        marked[real] = self.points[self.starts[which][word[real]] + inside[real] - 1]
        left, out, total = n[word] - inside, [], np.zeros(len(marked), np.uint64)
        padded = np.concatenate((marked, np.zeros(LONGEST, np.uint64)))
        for k in range(LONGEST):
            total = total + (padded[k : k + len(marked)] + np.uint64(1)) * factors(LONGEST)[k]
            out.append(np.where(left > k, np.maximum(mix(total + np.uint64(k)), np.uint64(1)), np.uint64(0)))
        out[0] = np.where(real, out[0], np.uint64(0))  # a mark alone says nothing
        return [h[left > 1] for h in out], word[left > 1], n - 1


class Table:
    """Log frequencies of keys per language: what a key adds to an unseen key's log frequency."""

    def __init__(self, keys: np.ndarray, first: np.ndarray, langs: np.ndarray, gain: np.ndarray, unseen: np.ndarray):
        self.keys, self.first, self.langs, self.gain, self.unseen = keys, first, langs, gain, unseen

    @staticmethod
    def counted(keys: np.ndarray, langs: np.ndarray, counts: np.ndarray, n_langs: int) -> tuple[np.ndarray, ...]:
        """The arrays of a table, from sorted and distinct (key, language)."""
        distinct, first = np.unique(keys, return_index=True)
        sums = np.bincount(langs, weights=counts, minlength=n_langs)
        unseen = np.log(SMOOTHING / (sums + SMOOTHING * max(len(distinct), 1)))
        return distinct, np.append(first, len(keys)).astype(np.int64), langs, np.log1p(counts / SMOOTHING).astype(np.float32), unseen

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, total: np.ndarray, rows: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
        """Add the weighted log frequencies of found keys to their rows."""
        n_rows, n_langs = total.shape
        total += np.bincount(rows, weights=weight, minlength=n_rows)[:, None] * self.unseen[None, :]
        n = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        cell = np.repeat(rows, n) * n_langs + self.langs[entry]
        total += np.bincount(cell, weights=np.repeat(weight, n) * self.gain[entry], minlength=total.size).reshape(total.shape)


class Model:
    """Languages in order of name, the table of words, and one table per length of n-gram.

    Built from plain arrays (``state``), which is also how it travels between processes.
    """

    def __init__(self, state: tuple[list[str], list[tuple[np.ndarray, ...]]]):
        self.state = state
        self.langs, (self.words, *self.grams) = state[0], [Table(*t) for t in state[1]]

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language of each text (-1: no letter) and its share of the probability."""
        w = Words(data, offsets)
        rows = len(offsets) - 1
        total = np.zeros((rows, len(self.langs)))
        at = self.words.find(w.hashes)
        known = at >= 0
        self.words.add(total, w.row[known], at[known], np.ones(int(known.sum())))
        unseen = np.flatnonzero(~known)
        if len(unseen):
            hashes, word, places = w.grams(unseen)
            open_ = np.ones(len(word), bool)
            for n in range(LONGEST, 0, -1):
                p = np.flatnonzero(open_ & (hashes[n - 1] != 0))
                found = self.grams[n - 1].find(hashes[n - 1][p])
                p, found = p[found >= 0], found[found >= 0]
                self.grams[n - 1].add(total, w.row[unseen[word[p]]], found, 1.0 / places[word[p]])
                open_[p] = False
        best = total.argmax(axis=1) if len(self.langs) else np.zeros(rows, np.int64)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if len(self.langs) else np.zeros(rows)
        none = np.bincount(w.row, minlength=rows) == 0 if len(self.langs) else np.ones(rows, bool)
        return np.where(none, -1, best), np.where(none, 0.0, share)


def summed(keys: np.ndarray, langs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts summed per (key, language), in order of both."""
    order = np.lexsort((langs, keys))
    keys, langs = keys[order], langs[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (langs[1:] != langs[:-1])
    at = np.flatnonzero(fresh)
    return keys[at], langs[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


class Counts:
    """Counts of words and n-grams per language, taken text by text and summed as they come."""

    #: Entries that wait beside the sums, at most as many as these hold or this many.
    WAITING = 1 << 18

    def __init__(self):
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.sums, self.waiting = [none] * (LONGEST + 1), [[] for _ in range(LONGEST + 1)]

    def _add(self, n: int, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray) -> None:
        self.waiting[n].append(summed(keys, langs, counts))
        if sum(len(w[0]) for w in self.waiting[n]) > max(self.WAITING, len(self.sums[n][0])):
            self._settle(n)

    def _settle(self, n: int) -> None:
        self.sums[n] = summed(*map(np.concatenate, zip(self.sums[n], *self.waiting[n])))
        self.waiting[n] = []

    def take(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> None:
        w = Words(data, offsets)
        lang = langs[w.row]
        self._add(0, w.hashes, lang, np.ones(len(lang), np.int64))
        # n-grams are taken from one of each of the piece's words, as often as it occurs
        order = np.lexsort((lang, w.hashes))
        keys, langs, counts = summed(w.hashes, lang, np.ones(len(lang), np.int64))
        first = order[np.cumsum(counts) - counts]
        hashes, word, _ = w.grams(first)
        for n, g in enumerate(hashes, 1):
            real = g != 0
            self._add(n, g[real], langs[word[real]], counts[word[real]])

    def state(self, langs: list[str], place: np.ndarray) -> tuple[list[str], list[tuple[np.ndarray, ...]]]:
        """What a model of these counts is built from; ``place`` gives each language's number in ``langs``."""
        for n in range(LONGEST + 1):
            self._settle(n)
        return langs, [Table.counted(*summed(k, place[l], c), len(langs)) for k, l, c in self.sums]


def fit(docs: DataFrame) -> Model:
    """A model from rows outside the held-out quarter with a text and a language.

    The sample takes rows by the hash of their id, one of each language in turn, up to
    ``MOST_ROWS`` rows and ``MOST_BYTES`` of text (a text that no longer fits is passed over).
    Rows with a null id are left out.
    """
    key = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    lang = F.col("lang").cast("string")
    known = docs.where(F.col("doc_id").isNotNull() & lang.isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text")).where(F.octet_length("text").between(1, MOST_BYTES))
    # the first rows of every slice of a language, then of the language: no task ranks more than a bounded number of rows in the end
    salt = F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("doc_id")), F.lit(SLICES))
    first = lambda df, *by: df.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(key, "doc_id"))).where(F.col("turn") <= MOST_ROWS)
    sliced = first(known.select("doc_id", "lang", salt.alias("slice")), "lang", "slice").drop("turn", "slice")
    ids = first(sliced, "lang").orderBy("turn", key, "lang").limit(MOST_ROWS)
    ids = ids.groupBy("doc_id", "lang").agg(F.min("turn").alias("turn"))
    rows = known.join(F.broadcast(ids), ["doc_id", "lang"]).orderBy("turn", key, "lang", "text").limit(MOST_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, numbers, used = Counts(), {}, 0
        for batch in batches:
            taken = []
            for n in np.diff(text_bytes(batch.column(0))[1]).tolist():
                taken.append(used + n <= MOST_BYTES)
                used += n if taken[-1] else 0
            batch = batch.filter(pa.array(taken, pa.bool_()))
            data, offsets = text_bytes(batch.column(0))
            langs = np.array([numbers.setdefault(x, len(numbers)) for x in batch.column(1).to_pylist()], np.int32)
            for i, j in pieces(offsets, STEP):
                counts.take(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], langs[i:j])
        names = sorted(numbers)
        order = {x: k for k, x in enumerate(names)}
        place = np.array([order[x] for x in numbers], np.int32)
        state = pickle.dumps(counts.state(names, place))
        del counts
        give_back()
        yield pa.RecordBatch.from_pydict({"model": [state]})

    got = rows.select("text", "lang").coalesce(1).mapInArrow(run, "model binary").collect()
    return Model(pickle.loads(got[0].model) if got else Counts().state([], np.zeros(0, np.int32)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Every row with its columns, and ``lang_pred`` and ``lang_score``.

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned.  A text of
    letters of which none is known gets the first language by name; so do equal scores.
    """
    src = docs.select(F.col("text").cast("string").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    shared = docs.sparkSession.sparkContext.broadcast(model.state)
    schema = T.StructType([src.schema["_row"], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(shared.value)
        names = np.array([*m.langs, UNKNOWN], object)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            best, share = np.full(len(batch), -1), np.zeros(len(batch))
            for i, j in pieces(offsets, STEP):
                best[i:j], share[i:j] = m.judge(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(names[best], pa.string()), pa.array(share)], names=["_row", "lang_pred", "lang_score"])
        give_back()

    return src.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; a null id is not held out."""
    told = identify(docs.select("doc_id", "text"), fit(docs))
    return told.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.coalesce(held_out(F.col("_row.doc_id")), F.lit(False)).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )
