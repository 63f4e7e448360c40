"""Jaccard join, suffix-array dedup and fingerprints beside plain versions."""

import random

import numpy as np
from brute import awkward, components, cut, frame, prose, repeats, same_rows, sha

from tidemark.llm import jaccard, paragraph_sketch, run_index


def test_components(spark):
    rows = awkward()
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows)).collect()]
    same_rows(got, components(rows))


def test_dense_and_split_groups(spark):
    """Copies that link only through others, around one line that every document holds."""
    rng = random.Random(9)
    base = prose(rng, 100).split(" ")
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(100)] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, "one line that every document of this half begins with " + prose(rng, 12)) for k in range(60)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows)).collect()]
    same_rows(got, components(rows))


def test_cluster_in_blocks(spark, monkeypatch):
    """A cluster larger than one task's share: chunks with pivots, then blocks against all."""
    for name, value in (("MOST_NODES", 12), ("PIVOTS", 2), ("LEFT", 5)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(10)
    base = prose(rng, 100).split(" ")
    rows = []
    for k in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(100)] = f"new{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows)).collect()]
    same_rows(got, components(rows))
    assert len({c for _, _, c in got}) > 3


def test_one_stays(spark):
    rows = awkward()
    kept = jaccard.one_per_group(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    comps = components(rows)
    want = {(d, t) for (d, t), (_, _, c) in zip(rows, comps) if d == c}
    assert set(got) == want and len(got) == len(want)


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(1)
    ids = [f"{rng.random():.12f}" for _ in range(600)]
    links = [(ids[i], ids[i + 1]) for i in range(299)] + [(ids[300], ids[k]) for k in range(301, 400)] + [(ids[rng.randrange(400, 600)], ids[rng.randrange(400, 600)]) for _ in range(150)]
    up = {x: x for x in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[top(a)] = top(b)
    got = {r.key: r.component for r in jaccard.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert len({(top(x), c) for x, c in got.items()}) == len(set(got.values())) == len({top(x) for x in got})


def test_no_documents(spark):
    empty = frame(spark, [])
    assert jaccard.join(empty).count() == 0 and jaccard.one_per_group(empty).count() == 0
    assert run_index.repeated_spans(empty).count() == 0 and run_index.without_repeats(empty).count() == 0
    assert paragraph_sketch.compare_versions(empty).count() == 0


def test_index_lengths():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.choice((1, 2, 3, 10, 60))
        s = np.array([rng.randrange(rng.choice((1, 2, 4))) for _ in range(n)], np.uint16)
        common = lambda a, b: next((k for k in range(n) if a + k >= n or b + k >= n or s[a + k] != s[b + k]), n)
        index = run_index.RunIndex(s)
        assert index.match_lengths().tolist() == [max([common(i, j) for j in range(n) if j != i] or [0]) for i in range(n)]
        assert index.length.sum() == n


def spans_equal(spark, rows):
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in run_index.repeated_spans(frame(spark, rows)).collect()]
    want = []
    for (d, _), (b, drop) in zip(rows, repeats([t for _, t in rows])):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], drop.astype(int), [0]))))
        want.append((d, len(b), [(int(x), int(y)) for x, y in edge.reshape(-1, 2)], cut(b, drop)))
    same_rows(got, want)


def test_repeated_bytes(spark):
    spans_equal(spark, awkward())


def test_anchor_with_very_many_surroundings(spark):
    """More surroundings than one index takes: strings are counted one by one."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, tails = text(170), [text(120) for _ in range(3)]
    rows = [(k, text(180) + shared + (tails[k % 3] if k % 50 == 0 else text(120)) + text(60)) for k in range(run_index.HOT + 300)]
    spans_equal(spark, rows)


def templated(rng):
    """A text of 360 bytes with every pair of digits in its middle, 8 bytes apart: no 200 bytes repeat."""
    text = "".join(rng.choice("abcdefgh ") for _ in range(360))
    return [text[:180] + a + text[181:188] + b + text[189:] for a in "0123456789" for b in "0123456789"]


def test_texts_that_differ_eight_bytes_apart(spark):
    rng = random.Random(12)
    texts = [templated(rng) for _ in range(24)]
    spans_equal(spark, list(enumerate(sum(texts, []))))
    for group in texts:
        data = np.frombuffer("".join(group).encode(), np.uint8)
        row, place, left, right, around, anchor, whole = run_index.surroundings(data, np.arange(len(group) + 1) * 360)
        assert len(np.unique(whole)) == len({(a.tobytes(), x, y) for a, x, y in zip(around, left, right)})
        strings = run_index.strings_of(row, place, left, right, around, np.arange(len(row)))  # as for a hot anchor
        told = {(k, group[r][s : s + 200]) for k, r, s in strings.tolist()}
        assert len({k for k, _ in told}) == len({t for _, t in told}) == len(told)


def test_pieces_that_begin_alike():
    """Surroundings at a document's beginning, a longer one before a shorter one."""
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).encode()
    first = text(900)
    docs = [first, text(300) + first[130:400] + text(300)]
    at = [(0, 120), (0, 50), (0, 300), (1, 470)]
    places, around = np.zeros(len(at), run_index.PLACE), np.zeros((len(at), run_index.AROUND), np.uint8)
    for k, (d, a) in enumerate(at):
        left, right = min(run_index.SIDE, a), min(run_index.SIDE, len(docs[d]) - a - run_index.ANCHOR)
        places[k] = d, a, left, right, k
        around[k, run_index.SIDE - left : run_index.SIDE + run_index.ANCHOR + right] = np.frombuffer(docs[d], np.uint8)[a - left : a + run_index.ANCHOR + right]
    doc, start, end = run_index.repeats(places, around, np.array([d for d, _ in at]))
    assert sorted(zip(doc.tolist(), start.tolist())) == [(0, s) for s in range(132, 201)] + [(1, s) for s in range(302, 371)]
    assert set((end - start).tolist()) == {run_index.LENGTH}


def test_repeats_at_the_beginning_in_one_part(spark):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    rng = random.Random(14)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = []
    for k in range(0, 120, 2):
        first = text(600)
        a = rng.randint(0, 180)
        rows += [(k, first), (k + 1, text(rng.randint(0, 300)) + first[a : a + rng.randint(200, 400)] + text(rng.randint(0, 300)))]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        spans_equal(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_cut_documents(spark):
    rows = awkward()
    out = run_index.without_repeats(frame(spark, rows))
    assert out.columns == frame(spark, []).columns
    want = [(d, cut(b, drop).decode(errors="ignore")) for (d, _), (b, drop) in zip(rows, repeats([t for _, t in rows]))]
    got = out.collect()
    same_rows([(r.doc_id, r.text) for r in got], want)
    assert all(r.n_chars == len(r.text) and r["a.b"] == "t" and r.rest == "m" for r in got)


def versions(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    out = []
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        out.append((d, t, t[: len(t) - h] + after[:h], after))
    return out


def test_fingerprints(spark):
    rows = awkward()
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in paragraph_sketch.compare_versions(frame(spark, rows)).collect()}
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    by_text = {}
    for d, t, e, n in versions(rows):
        r = got[d, len(t), sha(e)]
        a, b, c = (set(paragraph_sketch.digests(x).tolist()) for x in (t, e, n))
        assert abs(r.near_edited - share(a, b)) < 1e-12 and abs(r.near_next - share(a, c)) < 1e-12
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint and (t == e) <= (r.fingerprint == r.edited_fingerprint)
    assert len(set(by_text.values())) == len(by_text)
    one = paragraph_sketch.compare_versions(frame(spark, [(3, "alone. here")])).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == sha("alone." + "alone")


def test_peeling_recovers_differences():
    rng = np.random.default_rng(1)
    sets = [rng.integers(1, 2**63, n, dtype=np.uint64) for n in (0, 1, 5, 40, 900, 20_000)]
    a, b = [np.unique(np.concatenate((s, sets[3]))) for s in sets], [np.unique(np.concatenate((s[::2], sets[2]))) for s in sets]
    want = [(len(np.setdiff1d(x, y)), len(np.setdiff1d(y, x))) for x, y in zip(a, b)]
    assert paragraph_sketch.differences(a, b).tolist() == [list(w) for w in want]
