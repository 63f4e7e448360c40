"""Benchmark matches, licence notices, URL rules, language-model scores and the classifier."""

import math
import random
import re
import textwrap

import numpy as np
import pyarrow as pa
from brute import awkward, bench_words, frame, hits, prose, same_rows, sha
from pyspark.sql import functions as F

from tidemark.llm import backoff, benchmark_matches, licenses, quality, queries, url_trust
from tidemark.llm.columns import text_bytes

SF = "/root/testdata/sf0.001"


def bench_rows(rows):
    texts = dict(r for r in rows if r[0] is not None)
    return [(1, " ".join(bench_words(texts[9])[500:530])), (2, "One TWO"), (3, None), (4, ""), (5, " ".join(bench_words(texts[60])[60:75])), (5, "word"), (None, "the"), (7, "absent words only")]


def test_matches(spark, monkeypatch):
    rows = awkward()
    items = bench_rows(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = benchmark_matches.find_matches(frame(spark, rows), bench)
    want = [(d, *h) for (d, _), h in zip(rows, hits([t for _, t in rows], items))]
    told = lambda f: [(r.doc_id, r.n_words, r.n_hit, sorted({str(m.item_id) for m in r.matches})) for r in f.collect()]
    same_rows(told(found), want)
    monkeypatch.setattr(benchmark_matches, "MOST_BENCHMARK", 150)
    assert len(benchmark_matches.benchmark_parts(bench)) > 2
    same_rows(told(benchmark_matches.find_matches(frame(spark, rows), bench)), want)
    monkeypatch.undo()
    longest = {m.n_words for r in found.where("doc_id = 9").collect() for m in r.matches if m.item_id == "1"}
    assert longest == {30}
    told = benchmark_matches.report(found).where("n_items = 1 and doc_id = 7").first()
    assert told.items_sha256 == sha("2") and told.contaminated
    clean = benchmark_matches.decontaminated(frame(spark, rows), bench)
    assert clean.columns == frame(spark, []).columns and clean.count() == sum(not n for _, _, n, _ in want)
    assert benchmark_matches.find_matches(frame(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0
    assert benchmark_matches.find_matches(frame(spark, []), bench).count() == 0


def test_scores(spark):
    rows = awkward()
    docs = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    for order in (2, 3):
        got = sorted((r.doc_id or -1, r.n_words, round(r.log_score, 6)) for r in backoff.score(frame(spark, rows), order).collect())
        count = lambda ws: __import__("collections").Counter(tuple(ws[i - k + 1 : i + 1]) for k in range(1, order + 1) for i in range(k - 1, len(ws)))
        each = [count(w) for w in docs]
        total = sum(each, start=__import__("collections").Counter())
        words, want = sum(map(len, docs)), []
        for (d, _), w, own in zip(rows, docs, each):
            s = 0.0
            for i in range(len(w)):
                most = min(i, order - 1)
                for k in range(most, -1, -1):
                    g = tuple(w[i - k : i + 1])
                    c = total[g] - own[g]
                    if k and c > 0:
                        s += math.log(c / (total[g[:-1]] - own[g[:-1]])) + math.log(backoff.BACK) * (most - k)
                        break
                    if not k:
                        s += math.log((c if c > 0 else backoff.UNSEEN) / max(words - len(w), 1)) + math.log(backoff.BACK) * most
            want.append((d or -1, len(w), round(s, 6)))
        assert len(got) == len(want)
        assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 for a, b in zip(got, sorted(want)))
    assert backoff.score(frame(spark, [])).count() == 0


def test_notices(spark):
    rng = random.Random(6)
    rows = [
        (1, prose(rng, 50) + "\nReleased under the MIT License.\n" + prose(rng, 20)), (2, "LICENSED under the apache license, version 2.0!"),
        (3, "Licensed under the Apache License, Version 1.1."), (4, "Your driving license was found on the road near the river yesterday."), (5, None), (6, ""),
        (7, prose(rng, 5000) + " This work is licensed under the GNU General Public License, version 3. " + prose(rng, 5000)),
        (7, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0."), (8, prose(rng, 300)),
    ]
    got = licenses.scan(frame(spark, rows)).collect()
    same_rows([(r.doc_id, r.license, r.n_different) for r in got], [(1, "MIT", 0), (2, "Apache-2.0", 0), (3, "Apache-2.0", 1), (7, "GPL-3.0", 0), (7, "MIT", 0), (None, "CC-BY-NC-4.0", 0)])
    assert [r.differences for r in got if r.doc_id == 3] == [["-2.0 +1.1"]]
    text = rows[6][1]
    assert all(text[r.start :].startswith(r.text) for r in got if r.license == "GPL-3.0")
    assert licenses.scan(frame(spark, [])).count() == 0


def test_wrapped_notices(spark):
    rng = random.Random(7)
    wrap = lambda text, lead="": "\n".join(lead + w for w in textwrap.wrap(text, 72))
    mit = [w for n, w in licenses.TEMPLATES if n == "MIT" and len(w) > 80][1:]
    rows = [
        (1, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"),
        (2, prose(rng, 30) + "\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met\n\n" + prose(rng, 30)),
        (3, "MIT License\n\n" + "\n\n".join(wrap(t, " * ") for t in mit)),
        (4, "Licensed under CC BY-SA 4.0.\nThis work is licensed under the GNU\nGeneral Public License, version 2.\nReleased under the ISC License."),
        (5, "Permission is hereby granted, free of charge, to any person obtaining a copy\n\nof this software and associated documentation files"),
        (6, wrap(next(w for n, w in licenses.TEMPLATES if n == "MPL-2.0" and len(w) > 80), "# ")),
        (7, "// permission\n// is hereby granted, free of charge, to any person obtaining a copy of this software and\n// associated documentation files"),
    ]
    got = licenses.scan(frame(spark, rows)).collect()
    want = [(1, "MIT", 0), (2, "BSD", 0), *[(3, "MIT", 0)] * 3, (4, "CC-BY-SA-4.0", 0), (4, "GPL-2.0", 0), (4, "ISC", 0), (6, "MPL-2.0", 0), (7, "MIT", 0)]
    same_rows([(r.doc_id, r.license, r.n_different) for r in got], want)
    assert all(dict(rows)[r.doc_id][r.start :].startswith(r.text) for r in got)


def test_urls(spark):
    urls = [
        (1, "http://A.Example.COM/en/70?x#y", "example.com/en/7", "allow"), (2, "https://x.com/en/1", "com/en/", "block"), (3, "http://b.net/de/8", "net/de/", "allow"),
        (4, "http://b.example.net/de/80", "example.net/de/8", "block"), (5, "ftp://notcom/en/", None, "allow"), (6, None, None, "allow"), (7, "no scheme/en/", None, "allow"),
        (8, "http://c.org/es/", "org/es/", "block"), (9, "http://c.org/fr/", None, "block"), (10, "http://c.org?u=http://x.com/en/", None, "block"), (10, "http://c.org?u=http://x.com/en/", None, "block"),
        (11, "http://good.net/fr/", None, "allow"), (12, "http://good.net/de/", "net/de/", "allow"), (13, "http://links.io/", None, "block"), (14, "", None, "allow"),
    ]
    html = {13: '<a href="http://c.org/es/">x</a><a class=k HREF=/own>', 11: None}
    pages = spark.createDataFrame([(i, u, html.get(i, "<p>"), "a", "b") for i, u, _, _ in urls], "page_id long, url string, html string, host string, kind string")
    got = url_trust.judge_pages(pages).collect()
    same_rows([(r.page_id, r.rule, r.verdict) for r in got], [(i, r, v) for i, _, r, v in urls])
    by = {r.page_id: (r.host, r.path) for r in got}
    assert by[1] == ("a.example.com", "/en/70") and by[10] == ("c.org", "") and by[6] == by[7] == by[14] == ("", "") and by[5] == ("notcom", "/en/")
    assert url_trust.judge_pages(pages.limit(0)).count() == 0


def test_quality(spark):
    rng = random.Random(8)
    rows = [(k, prose(rng, 60)) if k % 3 else (k, " | ".join(prose(rng, 1) for _ in range(40)) + "$$$") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(400)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [*rows, (500, None), (501, ""), (None, "text"), (1, rows[1][1])])
    got = quality.judge(docs, labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert 40 < len(held) < 130 and all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    same_rows(got, quality.judge(docs, turned).collect())  # held-out labels are not learned
    kept = quality.kept(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert {r.score for r in quality.judge(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.judge(frame(spark, []), labels).count() == 0


def test_short_texts_at_the_end():
    odds = np.random.default_rng(3).normal(size=1 << quality.BITS).astype(np.float32)
    score = lambda texts: quality.scores(*text_bytes(pa.array(texts, pa.string())), odds, 0.5)
    for last in ([None], [""], ["a"], ["ab"], ["abc"], ["a", "", None], ["ab", "a"]):
        got = score(["some text of words", *last])
        assert len(got) == 1 + len(last) and (got[1:] > 0).all() and (got[1:] < 1).all()
        assert got[0] == score(["some text of words"])[0]
    assert np.allclose(score([None, ""]), 1 / (1 + math.exp(-0.5)))


def test_null_text_ends_the_table(spark):
    docs = frame(spark, [(1, "some text of words"), (2, "ab"), (3, "a"), (4, ""), (5, None)]).coalesce(1)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, labels).count() == 5


def test_registered_order(spark):
    """The registered query sees two words of context: a known triple outweighs a known pair."""
    import duckdb

    fn, sql = queries.QUERIES["op5_backoff_scores_order3"], queries.SQL["op5_backoff_scores_order3"]
    got = sorted((r.doc_id, r.n_words, r.log_score) for r in fn(spark, SF).collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS FROM read_parquet('{SF}/documents.parquet')")
        want = sorted(db.execute(f"SELECT doc_id, n_words, log_score FROM ({sql})").fetchall())
    assert len(got) == len(want) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 0.002 for a, b in zip(got, want))
    two = {r.doc_id: r.log_score for r in queries.QUERIES["op5_backoff_scores"](spark, SF).collect()}
    assert any(two[d] != s for d, _, s in got)


def test_examples_take_half():
    """The sample of 6,000 rows and 32 MB in the memory of half of it, and nothing of it lost."""
    assert (quality.MOST_ROWS, quality.MOST_BYTES) == (6000, 32 << 20)
    rng = random.Random(15)
    texts = [prose(rng, n) for n in (3000, 400, 1)] + ["", None]
    for buckets, weight in quality.sparse(*text_bytes(pa.array(texts, pa.string()))):
        example = quality.packed(buckets, weight)
        b, w = quality.unpacked(example)
        assert b.dtype == buckets.dtype and b.tolist() == buckets.tolist() and w.dtype == weight.dtype and w.tolist() == weight.tolist()
        assert len(b) < 500 or sum(x.nbytes for x in example) < 0.55 * (b.nbytes + w.nbytes)
