"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import backoff, centroids, url_trust

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _url_trust() -> str:
    host = "coalesce(" + LOWER.format("regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1)") + ", '')"
    rule = verdict = "NULL"
    for kind, text in sorted(url_trust.RULES, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        name, slash, prefix = text.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + prefix}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    steps = "".join(
        f""", s{k} AS (SELECT kind, host, sum(score) AS score FROM (
            SELECT kind, host, {1 - url_trust.DAMPING} * start AS score FROM begin_at
            UNION ALL SELECT s.kind, f.dst, s.score * f.share * {url_trust.DAMPING} FROM s{k - 1} s JOIN flow f ON s.host = f.src AND s.kind = f.kind) GROUP BY ALL)"""
        for k in range(1, url_trust.ITERATIONS + 1)
    )
    return f"""
    WITH p AS (SELECT page_id, {host.format('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    j AS (SELECT *, {rule} AS rule, {verdict} AS ruled FROM p),
    linked AS (SELECT {host.format('url')} AS src, unnest(regexp_extract_all(html, '(?i)\\shref\\s*=\\s*["'']?(\\w+://[^\\s"''>]*|)', 1)) AS target FROM pages),
    links AS (SELECT src, CASE WHEN target = '' THEN src ELSE {host.format('target')} END AS dst FROM linked),
    up AS (SELECT DISTINCT host AS src, substr(host, instr(host, '.') + 1) AS dst FROM p WHERE instr(host, '.') > 0),
    edges AS (SELECT src, dst, sum(n) AS n FROM (
        SELECT src, dst, 1 AS n FROM links WHERE src <> '' AND dst <> '' UNION ALL SELECT src, dst, 1 FROM up UNION ALL SELECT dst, src, 1 FROM up) GROUP BY ALL),
    both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
    flow AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_ways),
    seeds AS (SELECT host, CASE WHEN ruled = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, count(*) AS n FROM j WHERE ruled IS NOT NULL AND host <> '' GROUP BY ALL),
    begin_at AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS start FROM seeds),
    s0 AS (SELECT kind, host, start AS score FROM begin_at){steps},
    scores AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END) / sum(score) AS host_score FROM s{url_trust.ITERATIONS} GROUP BY host)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(host_score, 1.0) >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict, round(host_score, 9) AS host_score
    FROM j LEFT JOIN scores USING (host)"""


def _spaced_words(text: str) -> str:
    return f"regexp_extract_all({LOWER.format(f'coalesce({text}, $$$$)')}, '[^\\x20\\x09-\\x0D]+')"


JACCARD = f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_spaced_words('text')} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
    FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)"""

_ITEM_WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
BENCHMARK = f"""
    WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ITEM_WORDS} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
    placed AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM (
        SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
    hit AS (SELECT placed.doc_id, placed.i, placed.n, win.item_id FROM placed JOIN win USING (n, t)),
    words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

REPEATS = """
    WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    n AS (SELECT doc_id, h, len(h) // 2 AS n FROM b),
    g AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM n WHERE n >= 200)),
    twice AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
    r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (
        SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM g WHERE k IN (FROM twice))),
    spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM r GROUP BY doc_id, span),
    gaps AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since, a AS until FROM (
        SELECT doc_id, a, z FROM spans UNION ALL SELECT doc_id, n, n FROM n)),
    kept AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (until - since)), '' ORDER BY since, until) AS kept FROM gaps JOIN n USING (doc_id) GROUP BY doc_id),
    s AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
    SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
    FROM n JOIN kept USING (doc_id) LEFT JOIN s USING (doc_id)"""


def _backoff() -> str:
    """For the production order of two words."""
    assert backoff.ORDER == 2
    return f"""
    WITH d AS (SELECT doc_id, {_spaced_words('text')} AS w FROM documents),
    t AS (SELECT doc_id, i, w[i] AS w2, CASE WHEN i > 1 THEN w[i - 1] END AS w1 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
    c AS (SELECT doc_id, i, w1,
        count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n,
        count(*) OVER (PARTITION BY w2) - count(*) OVER (PARTITION BY w2, doc_id) AS c2,
        count(*) OVER (PARTITION BY w1, w2) - count(*) OVER (PARTITION BY w1, w2, doc_id) AS c12 FROM t),
    k AS (SELECT *, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS c1 FROM c),
    l AS (SELECT doc_id, CASE WHEN w1 IS NOT NULL AND c12 > 0 THEN ln(c12 / c1)
        ELSE ln(CASE WHEN c2 > 0 THEN c2 ELSE {backoff.UNSEEN} END / greatest(n, 1)) + CASE WHEN w1 IS NULL THEN 0 ELSE ln({backoff.BACK}) END END AS s FROM k)
    SELECT d.doc_id, len(w) AS n_words, round(coalesce(sum(s), 0), 3) AS log_score, round(sum(s) / nullif(len(w), 0), 6) AS mean_log_score
    FROM d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id, len(w)"""


def _backoff_order3() -> str:
    """For three words."""
    step = f"ln({backoff.BACK})"
    return f"""
    WITH d AS (SELECT doc_id, {_spaced_words('text')} AS w FROM documents),
    t AS (SELECT doc_id, i, w[i] AS w3, CASE WHEN i > 1 THEN w[i - 1] END AS w2, CASE WHEN i > 2 THEN w[i - 2] END AS w1 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
    c AS (SELECT doc_id, i, w1, w2,
        count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n,
        count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY w3, doc_id) AS c3,
        count(*) OVER (PARTITION BY w2, w3) - count(*) OVER (PARTITION BY w2, w3, doc_id) AS c23,
        count(*) OVER (PARTITION BY w1, w2, w3) - count(*) OVER (PARTITION BY w1, w2, w3, doc_id) AS c123 FROM t),
    k AS (SELECT *, lag(c3) OVER (PARTITION BY doc_id ORDER BY i) AS c2, lag(c23) OVER (PARTITION BY doc_id ORDER BY i) AS c12 FROM c),
    l AS (SELECT doc_id, CASE WHEN w1 IS NOT NULL AND c123 > 0 THEN ln(c123 / c12)
        WHEN w2 IS NOT NULL AND c23 > 0 THEN ln(c23 / c2) + CASE WHEN w1 IS NULL THEN 0 ELSE {step} END
        ELSE ln(CASE WHEN c3 > 0 THEN c3 ELSE {backoff.UNSEEN} END / greatest(n, 1)) + CASE WHEN w2 IS NULL THEN 0 WHEN w1 IS NULL THEN {step} ELSE 2 * {step} END END AS s FROM k)
    SELECT d.doc_id, len(w) AS n_words, round(coalesce(sum(s), 0), 3) AS log_score, round(sum(s) / nullif(len(w), 0), 6) AS mean_log_score
    FROM d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id, len(w)"""


TRIE = """
    WITH RECURSIVE bits AS (SELECT i, i AS r, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, k + 1 FROM bits WHERE k < 8),
    crc_table AS (SELECT list(r ORDER BY i) AS tab FROM bits WHERE k = 8),
    crc AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s, CAST(4294967295 AS BIGINT) AS c, 0 AS k FROM conversations WHERE conv_id IS NOT NULL
        UNION ALL SELECT conv_id, s, xor(tab[(xor(c, CAST(ascii(s[k + 1]) AS BIGINT)) & 255) + 1], c // 256), k + 1 FROM crc, crc_table WHERE k < length(s)),
    c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS position FROM c),
    lengths AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
    h AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base, xor(crc.c, 4294967295) % 9 AS h FROM lengths JOIN crc USING (conv_id) WHERE k = length(s)),
    whole AS (SELECT h.*, least(h, coalesce(b.n, 0)) AS kept FROM h LEFT JOIN lengths b ON h.base = b.conv_id),
    r AS (SELECT w.conv_id, t.position AS depth, role, text FROM whole w JOIN t ON t.conv_id = w.base AND t.position <= w.h
        UNION ALL SELECT w.conv_id, t.position - w.h + w.kept, role, text FROM whole w JOIN t ON t.conv_id = w.conv_id AND t.position > w.h),
    p AS (SELECT conv_id, depth, list(md5(role || chr(0) || text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path, octet_length(encode(text)) AS n_bytes FROM r
        UNION ALL SELECT conv_id, 0, [], 0 FROM whole),
    s AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM p),
    nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(n_bytes) AS saved,
        count(*) = count(*) FILTER (is_end) AS leaf, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (is_end) AS ends FROM s GROUP BY path, depth),
    up AS (SELECT a.path, sum(n.saved) AS saved_tokens, count(*) FILTER (n.leaf) AS n_leaves, count(*) FILTER (n.depth = a.depth + 1) AS n_children
        FROM nodes n JOIN s a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.path)
    SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
    FROM nodes n JOIN up USING (path) LEFT JOIN nodes m ON m.depth = n.depth - 1 AND m.path = n.path[: n.depth - 1]"""


def _centroids() -> str:
    edge, k = centroids.LARGEST, centroids.CLUSTERS
    steps = ""
    for r in range(centroids.ROUNDS + 1):
        steps += f""",
    d{r} AS MATERIALIZED (SELECT vec_id, k, sum((q - c) * (q - c)) AS d FROM q JOIN c{r} USING (j) GROUP BY vec_id, k),
    a{r} AS MATERIALIZED (SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{r} GROUP BY vec_id)"""
        if r < centroids.ROUNDS:
            steps += f""",
    m{r} AS MATERIALIZED (SELECT k, j, sum(q)::BIGINT AS s, count(*) AS n FROM a{r} JOIN q USING (vec_id) GROUP BY k, j),
    c{r + 1} AS MATERIALIZED (SELECT k, j, coalesce((s - (s % n + n) % n) // n, c) AS c FROM c{r} LEFT JOIN m{r} USING (k, j))"""
    r = centroids.ROUNDS
    return f"""
    WITH e AS (SELECT vec_id, j, CAST(embedding[j] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, {centroids.DIMENSIONS + 1})) AS j FROM embeddings WHERE len(embedding) = {centroids.DIMENSIONS})),
    fine AS (SELECT vec_id FROM e GROUP BY vec_id HAVING count(x) = {centroids.DIMENSIONS} AND bool_and(isfinite(x))),
    q AS MATERIALIZED (SELECT vec_id, j, CAST(floor(greatest(least(256 * x, {edge}), -{edge})) AS BIGINT) AS q FROM e JOIN fine USING (vec_id)),
    first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{centroids.SALT}:' || CAST(vec_id AS VARCHAR))) - 1 AS k FROM fine QUALIFY k < {k}),
    c0 AS MATERIALIZED (SELECT k, j, q AS c FROM first JOIN q USING (vec_id)){steps},
    i AS (SELECT k, sum(d) AS cluster_inertia FROM a{r} GROUP BY k),
    h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{r} GROUP BY k)
    SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(cluster_inertia AS BIGINT) AS cluster_inertia,
        CAST((SELECT sum(d) FROM a{r}) AS BIGINT) AS inertia, centroid_sha256 FROM a{r} JOIN i USING (k) JOIN h USING (k)"""


SQL = {
    "op11_prefix_trie": TRIE,
    "op12_centroids": _centroids(),
    "op3_jaccard_join": JACCARD,
    "op4_url_trust": _url_trust(),
    "op5_backoff_scores": _backoff(),
    "op5_backoff_scores_order3": _backoff_order3(),
    "op9_benchmark_matches": BENCHMARK,
    "op10_run_index": REPEATS,
}
