"""Run registered queries beside their SQL and print mismatches.

python tests/check_queries.py [name-prefix ...] [--sf 0.01]
"""

from __future__ import annotations

import math
import re
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/sf{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def close(a, b):
    if type(a) is not type(b) and not (isinstance(a, (int, float)) and isinstance(b, (int, float))):
        return a == b
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b


def compare(spark, con, name, fn, sql, sf):
    t0 = time.time()
    df = fn(spark, f"{DATA}/sf{sf}")
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - t0
    if sql is None:
        return ("rows-only", len(got), spent, "")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return ("FAIL", len(got), spent, f"columns {sorted(df.columns)} != {sorted(names)}")
    bad = []
    for f in df.schema.fields:
        s, q = f.dataType.simpleString(), types[f.name]
        ok = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(s)
        if ok and ok not in q.upper():
            bad.append(f"{f.name}:{s}/{q}")
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return ("FAIL", len(got), spent, f"rows {len(a)} != {len(b)}; {bad}")
    exact = 0
    for x, y in zip(a, b):
        if x != y:
            exact += 1
            if not all(close(p, q) for p, q in zip(x, y)):
                return ("FAIL", len(got), spent, f"{sorted(names)}\n   spark {x}\n   sql   {y} {bad}")
    note = (f"near-only {exact} " if exact else "") + (f"types {bad}" if bad else "")
    return ("ok" if got else "EMPTY", len(got), spent, note)


def main(argv):
    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i : i + 2]
    import __spark_entry__ as e
    from tidemark import build_session

    spark = build_session()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    q, o = e.queries(), e.oracle_sql()
    picked = [n for n in q if not argv or any(re.match(a, n) for a in argv)]
    counts = {}
    for n in picked:
        try:
            st, rows, spent, note = compare(spark, con, n, q[n], o.get(n), sf)
        except Exception as ex:  # noqa: BLE001
            st, rows, spent, note = "ERROR", 0, 0.0, str(ex)[:400]
        counts[st] = counts.get(st, 0) + 1
        print(f"{st:9s} {n:40s} rows={rows:<7d} {spent:6.2f}s {note}", flush=True)
    print(counts)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
