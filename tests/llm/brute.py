"""Plain versions of the operators, and small tables with awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in ("key", "block", "rest", "mark", "ord", "range", "_row", "n", "ids", "a.b", "__gone")],
])


def frame(spark, rows):
    """Documents with further columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, *"klmnopqrstu") for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(("the", "of", "and", "be")) if rng.random() < 0.2 else "".join(rng.choice(("th", "er", "on", "an", "re", "é", "日")) for _ in range(rng.randint(1, 5))) for _ in range(n))


def awkward(seed=5):
    """Copies, near copies, chains, nulls, empties, a long text, repeated rows and ids, null ids."""
    rng = random.Random(seed)
    base, long = prose(rng, 120), prose(rng, 30_000)
    words = base.split(" ")
    rows = [(1, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, " \n\t "), (7, "One two"), (8, "one TWO"), (9, long), (9, long), (None, base), (None, prose(rng, 50))]
    chain = words
    for k in range(10, 22):
        chain = list(chain)
        chain[rng.randrange(len(chain))] = f"changed{k}"
        rows.append((k, " ".join(chain)))
    line = "This very common line stands in many of the documents of this table, whatever they say. "
    rows += [(k, prose(rng, 30) + "\n" + line + prose(rng, 30)) for k in range(30, 60)]
    passage = prose(rng, 70)
    rows += [(k, prose(rng, 40) + " " + passage + " " + prose(rng, 40)) for k in range(60, 66)]
    rows += [(70, "ab " * 400), (71, "x" * 5000), (72, "日" * 300), (1, "another text with the id of the first one"), (73, "word")]
    return rows


def shingles(text, size=5):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(rows):
    """Size and component id of each row."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(sets[i]), least.get(top(i))) for i, (d, _) in enumerate(rows)]


def repeats(texts, length=200):
    """For each text its bytes, and which of them repeated strings cover."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[i : i + length]) for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        drop = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[hash(b[i : i + length])] > 1:
                drop[i : i + length] = True
        out.append((b, drop))
    return out


def cut(b, drop):
    return bytes(np.frombuffer(b, np.uint8)[~drop])


def bench_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(texts, items):
    """Words, words hit and items of each text."""
    windows = {}
    for i, t in items:
        w = bench_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for t in texts:
        w, covered, found = bench_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    found |= got
                    covered |= set(range(k, k + n))
        out.append((len(w), len(covered), sorted(found)))
    return out


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def same_rows(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))
