"""Side-by-side comparison of registered queries with DuckDB."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "as_tuple"):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"rows={len(got)} spark={t1 - t0:.1f}s (no SQL)"
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    want = rel.fetchall()
    t2 = time.time()
    note = f"rows={len(got)} spark={t1 - t0:.1f}s sql={t2 - t1:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return False, f"{note} columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = _rows(df.columns, got), _rows(cols, want)
    if a == b:
        return True, note
    in_a, in_b = set(a), set(b)
    only_a = [r for r in a if r not in in_b][:2]
    only_b = [r for r in b if r not in in_a][:2]
    return False, f"{note} want_rows={len(b)}\n    spark only {str(only_a)[:700]}\n    sql only   {str(only_b)[:700]}"


if __name__ == "__main__":
    from docframe.plans.catalog import ORACLES, QUERIES
    from docframe.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    picks = sys.argv[1:] or list(QUERIES)
    picks = [q for p in picks for q in QUERIES if q == p or (p.endswith("*") and q.startswith(p[:-1]))]
    spark, con = local_session(), connect(sf)
    bad = 0
    for q in picks:
        try:
            ok, note = compare(spark, con, q, QUERIES[q], ORACLES.get(q), sf)
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc).strip()[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", q, note, flush=True)
    print("failed:", bad, "of", len(picks), "without SQL:", sum(q not in ORACLES for q in picks))
