"""Stupid-backoff language-model scores from the corpus's own n-gram counts.

The count tables of all orders lie in hash parts.  Each block of documents sends its distinct
n-grams with their counts, gets the corpus totals back, joins them to the n-grams of its
documents and sums per document.  A document's own occurrences are taken out of every count, so
that no text vouches for itself.  An n-gram that every document holds costs an entry per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.blocks import COUNTED, answered, blocked, send, table_bytes, total_by_part
from tidemark.llm.columns import LOWER, byte_table, mix, pieces, run_hashes, word_runs

#: Longest n-gram, factor per step back, and the count given to a word that no other document has.
ORDER, BACK, UNSEEN = 2, 0.4, 0.5
#: Bits of an n-gram's hash, which tells n-grams apart.
BITS = 48
#: The key whose count is the number of words in the corpus.
ALL_WORDS = np.uint64(0)
#: Words are runs of anything but ASCII white space, A-Z in lower case.
WORD = ~byte_table([(0x09, 0x0D), (0x20, 0x20)])


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and place of every word, and the keys of the n-grams that end there (one column per order; 0: none)."""
    rows, places, keys = [], [], []
    for i, j in pieces(offsets, 1 << 20):
        low = LOWER[data[offsets[i] : offsets[j]]]
        starts, lengths, row = word_runs(low, offsets[i : j + 1] - offsets[i], WORD)
        words = run_hashes(low, starts, lengths)
        first = np.searchsorted(row, np.arange(j - i + 1))
        place = np.arange(len(words)) - first[row]
        out, h = np.zeros((len(words), order), np.uint64), np.zeros(len(words), np.uint64)
        for k in range(order):  # the hash of words i-k .. i, from the last to the first
            back = np.concatenate((np.zeros(min(k, len(words)), np.uint64), words[: max(0, len(words) - k)]))
            h = mix(h + back * np.uint64(2 * k + 1) + np.uint64(k + 1))
            out[:, k] = np.where(place >= k, np.maximum(h >> np.uint64(64 - BITS), np.uint64(1)), ALL_WORDS)
        rows.append(row + i)
        places.append(place)
        keys.append(out)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, order), np.uint64)
    return np.concatenate(rows), np.concatenate(places), np.concatenate(keys)


def own_counts(row: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How often an n-gram (a number in the block) occurs in its row, for every occurrence."""
    packed = row.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)
    _, back, count = np.unique(packed, return_inverse=True, return_counts=True)
    return count[back]


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score`` of every document row.

    A word's score is the relative frequency of the longest n-gram that ends there and occurs in
    another document, times 0.4 per shorter order; a word that no other document has counts one
    half.  Texts without words (null, empty) have the sum 0 and no mean.  Repeated rows count as
    documents of their own.
    """
    b = blocked(docs)
    parts = b.parts
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("log_score", T.DoubleType()), T.StructField("mean_log_score", T.DoubleType()),
    ])

    def keys_of(table: pa.Table):
        row, place, keys = grams(*table_bytes(table), order)
        return row, place, keys

    def tell(block, table):
        _, _, keys = keys_of(table)
        distinct, counts = np.unique(keys, return_counts=True)
        at = np.searchsorted(distinct, ALL_WORDS)
        if at < len(distinct) and distinct[at] == ALL_WORDS:
            distinct, counts = np.delete(distinct, at), np.delete(counts, at)
        return send(block, np.concatenate(([ALL_WORDS], distinct)), np.concatenate(([len(keys)], counts)), parts, BITS)

    def sum_up(block, table, answers):
        row, place, keys = keys_of(table)
        rows, totals = table.num_rows, answered(answers)
        n_words = np.bincount(row, minlength=rows)
        logs = np.zeros(len(row))
        if len(row):
            distinct = np.unique(keys)
            distinct = distinct[distinct != ALL_WORDS]
            others = []
            for k in range(order):
                has = keys[:, k] != ALL_WORDS
                ids = np.searchsorted(distinct, keys[has, k])
                c = np.zeros(len(row))
                c[has] = totals[1 + ids] - own_counts(row[has], ids)
                others.append(c)
            words = np.maximum(totals[0] - n_words[row], 1)
            done = np.zeros(len(row), bool)
            for k in range(order - 1, 0, -1):
                # the context of the n-gram that ends here is the (n-1)-gram that ends one word before
                context = np.concatenate(([0.0], others[k - 1][:-1]))
                use = ~done & (place >= k) & (others[k] > 0)
                steps = np.minimum(place, order - 1) - k
                logs[use] = np.log(others[k][use] / context[use]) + np.log(BACK) * steps[use]
                done |= use
            rest = ~done
            logs[rest] = np.log(np.where(others[0][rest] > 0, others[0][rest], UNSEEN) / words[rest]) + np.log(BACK) * np.minimum(place, order - 1)[rest]
        total = np.bincount(row, weights=logs, minlength=rows)
        mean = np.divide(total, n_words, out=np.zeros(rows), where=n_words > 0)
        return pa.table([
            table.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(total, pa.float64()), pa.array(mean, pa.float64(), mask=n_words == 0),
        ], names=schema.names)

    return b.join(total_by_part(b.map(tell, COUNTED), parts, BITS), sum_up, schema)
