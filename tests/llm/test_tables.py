"""Prefix tries, centroid clustering and language ID beside plain versions."""

import hashlib
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import sha
from pyspark.sql import functions as F

from tidemark.llm import centroids, languages, prefix_trie, queries

SF = "/root/testdata/sf0.001"
CONVERSATIONS = "conv_id long, turn int, role string, text string, depth string, x string, shard string, n string, bucket string"


def plain_trie(rows):
    """Nodes by brute force: every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    told = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in told:
        h = zlib.crc32(str(c).encode()) % 9
        base = abs(c) // 5 * 5 * (1 if c >= 0 else -1)
        path = tuple(told.get(base, [])[:h] + told[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    out = []
    for node, cs in members.items():
        below = [u for u in members if u[: len(node)] == node]
        children = sum(len(u) == len(node) + 1 for u in below)
        leaves = sum(not any(len(v) == len(u) + 1 and v[: len(u)] == u for v in below) for u in below)
        saved = sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in below if u)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), children, leaves, saved, sha(",".join(map(str, sorted(ends[node]))))))
    return out


def trie_rows(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], CONVERSATIONS)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return [tuple(r[c] for c in columns) for r in prefix_trie.trie(frame, **more).collect()]


def awkward_conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 40), 55, 57, 59, -1, -7, 1003]:
        for t in range(rng.choice((1, 1, 2, 3, 5, 12))):
            rows.append((c, t, rng.choice(("user", "assistant")), rng.choice(("one", "two", "né", "one"))))
    common = [(t, "user", f"the same {t}") for t in range(10)]
    rows += [(c, *x) for c in range(100, 160) for x in common]
    rows += [(200, None, "user", "null turn"), (200, 0, None, None), (200, 0, "b", "tie"), (200, 0, "a", "tie"), (200, 0, "a", "other"), (200, 0, "a", "other"), (None, 0, "user", "nobody's"), (201, 3, "user", "x" * 100_000), (202, 0, "", "")]
    return rows


def test_trie(spark):
    rows = awkward_conversations()
    want = sorted(plain_trie(rows), key=repr)
    assert sorted(trie_rows(spark, rows), key=repr) == want
    assert sorted(trie_rows(spark, rows, n_shards=1), key=repr) == want
    assert trie_rows(spark, []) == []
    assert sorted(trie_rows(spark, [(7, 0, "user", "gone"), (7, 1, "user", "gone too")])) == plain_trie([(7, 0, "user", "gone"), (7, 1, "user", "gone too")])


def test_trie_of_long_conversations_in_buckets(spark, monkeypatch):
    """Positions and keys carried over buckets, and ids over chunks."""
    monkeypatch.setattr(prefix_trie, "BUCKET", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK", 8)
    rows = awkward_conversations() + [(300, t, "user", f"{t % 7}") for t in range(60)]
    assert sorted(trie_rows(spark, rows), key=repr) == sorted(plain_trie(rows), key=repr)


def test_queue_spills():
    rng = random.Random(1)
    sent = [((rng.randrange(50), rng.randrange(3)), (rng.randrange(9), 1, 2)) for _ in range(3000)]
    queue, want = prefix_trie.SpillingQueue(most=7), defaultdict(lambda: (0, 0, 0))
    for k, m in sent:
        queue.push(k, m)
        want[k] = tuple(a + b for a, b in zip(want[k], m))
    assert len(queue.runs) > 1
    assert [(k, queue.take(k)) for k in sorted(want)] == sorted(want.items())
    assert queue.take((99, 0)) == (0, 0, 0) and not queue.heap and not queue.runs


def test_trie_of_the_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    got = [tuple(r) for r in queries.QUERIES["op11_prefix_trie"](spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(plain_trie(rows), key=repr)


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for n in range(len(cents)):
            mine = [v for (_, v), a in zip(kept, at) if a == n]
            if mine:
                cents[n] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in last)
    return [(i, n, d, sum(e for _, e, m in last if m == n), total, sha(",".join(map(str, cents[n])))) for i, d, n in last]


def test_clusters(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 64).astype(np.float32).tolist()) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(200, 260)]  # one vector many times
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65), (304, [None] + [0.5] * 63), (305, [float("nan")] + [0.5] * 63), (306, [float("inf")] * 64), (307, [0.0] * 64), (308, [-1e-9] * 64)]
    frame = lambda r: spark.createDataFrame([(i, v, 1, "c") for i, v in r], "vec_id long, embedding array<float>, cluster int, q string")
    got = [tuple(r) for r in centroids.cluster(frame(rows).repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(plain_clusters(rows), key=repr)
    few = rows[:7] + rows[:2]
    assert sorted(map(tuple, centroids.cluster(frame(few)).collect())) == sorted(plain_clusters(few))
    assert centroids.cluster(frame([(1, None)])).count() == 0 and centroids.cluster(frame([])).count() == 0
    huge = centroids.cluster(frame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)])).collect()
    assert {r.distance for r in huge} == {0}


@pytest.mark.parametrize("share", [0.0, 0.25, 1.0])
def test_dictionaries_lose_nothing(share):
    rng = np.random.default_rng(8)
    rows = np.repeat(rng.integers(-30, 30, (80, 64)), 5, axis=0)
    blocks = centroids.encode(rows, share)
    assert (np.concatenate([e[c] for c, e in blocks], axis=1) == rows).all()
    assert all(len(np.unique(e, axis=0)) == len(e) for _, e in blocks)
    assert len(blocks) == (1 if share >= 0.25 else 64)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y") for i, t, lang in rows], "doc_id long, text string, lang string, lang_pred string, _row string")


def plain_language(train, text):
    """Scores of one text by dictionaries: words first, then the longest known n-gram at each place."""
    part = lambda ch: unicodedata.category(ch)[0] in "LM"
    words = lambda t: [w for w in "".join(ch if part(ch) else " " for ch in "".join(c.lower() if len(c.lower()) == 1 else c for c in t)).split(" ") if any(unicodedata.category(c)[0] == "L" for c in w)]
    langs = sorted({lang for _, lang in train})
    count = [defaultdict(Counter) for _ in range(languages.LONGEST + 1)]
    for t, lang in train:
        for w in words(t):
            count[0][lang][w] += 1
            m = f" {w} "
            for n in range(1, languages.LONGEST + 1):
                for k in range(len(m) - 1):
                    if k + n <= len(m) and not (n == 1 and k == 0):
                        count[n][lang][m[k : k + n]] += 1
    known = [set().union(*c.values()) for c in count]
    a = languages.SMOOTHING
    log = lambda n, lang, g: np.log((count[n][lang][g] + a) / (sum(count[n][lang].values()) + a * len(known[n])))
    total = {lang: 0.0 for lang in langs}
    found = words(text or "")
    for w in found:
        if w in known[0]:
            for lang in langs:
                total[lang] += log(0, lang, w)
            continue
        m = f" {w} "
        for k in range(len(m) - 1):
            for n in range(min(languages.LONGEST, len(m) - k), 0, -1):
                if m[k : k + n] in known[n] and not (n == 1 and k == 0):
                    for lang in langs:
                        total[lang] += log(n, lang, m[k : k + n]) / (len(m) - 1)
                    break
    if not found or not langs:
        return "und", 0.0
    best = max(langs, key=lambda x: total[x])
    return best, 1 / sum(np.exp(total[x] - total[best]) for x in langs)


def test_languages(spark):
    kept = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 != 2]
    train = [("the cat sat on the mat and the dog", "en"), ("der hund und die katze, der Öl", "de"), ("le chien et le chat à l'été", "fr"), ("THE end of it all", "en")]
    rows = [(kept[k], t, lang) for k, (t, lang) in enumerate(train)]
    others = [None, "", "  \n ", "123 !?", "the", "katzen", "hunden und katzenöl", "chiennes", "THEN catty dogs", "日本語", "été chat", "ζ", "a", "l'", "\U00020000", "́", "x" * 3000 + " le chat", "the " * 50_000 + "und", None]
    rows += [(kept[50 + k], t, None) for k, t in enumerate(others)] + [(None, "le chat", "de"), (None, None, None), (kept[1], *train[1])]
    texts = {i: t for i, t, _ in rows if i is not None}
    got = languages.report(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            continue
        text, lang, score = texts[r.doc_id], r.lang_pred, r.score
        want = plain_language([*train, train[1]], text)
        assert lang == want[0] and abs(score - want[1]) < 1e-5, (text and text[:30], lang, score, want)
    told = languages.identify(documents(spark, rows), languages.fit(documents(spark, rows)))
    assert told.columns == ["_row", "lang_pred", "lang_score"] and told.count() == len(rows)


def test_languages_without_rows_or_examples(spark):
    assert languages.report(documents(spark, [])).count() == 0
    told = languages.report(documents(spark, [(1, "the", None), (2, None, "en"), (None, "a", "en")])).collect()
    assert {(r.lang_pred, r.score) for r in told} == {("und", 0.0)}
    assert {r.held_out for r in told if r.doc_id is None} == {False}


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = languages.report(docs).where("held_out").join(docs.where("length(text) > 40").select("doc_id", "lang"), "doc_id").collect()
    assert len(told) > 150 and np.mean([r.lang == r.lang_pred for r in told]) > 0.97
    changed = docs.withColumn("lang", F.when(languages.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in told) == sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in languages.report(changed).where("held_out").join(docs.where("length(text) > 40").select("doc_id"), "doc_id").collect())
