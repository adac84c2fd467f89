"""Run registered queries and compare them with their oracle SQL in DuckDB.

usage: python tools/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-6 * max(1.0, abs(a))
    return type(a) is type(b) and a == b


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(spark, con, q, sf):
    t0 = time.time()
    df = q.fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    secs = time.time() - t0
    if q.sql is None:
        return ("rows-only" if got else "EMPTY"), secs, len(got), ""
    rel = con.sql(q.sql)
    ecols, erows = list(rel.columns), rel.fetchall()
    gc, g = rows_of(df.columns, got)
    ec, e = rows_of(ecols, erows)
    if gc != ec:
        return "COLUMNS", secs, len(got), f"{gc} vs {ec}"
    if len(g) != len(e):
        return "ROWCOUNT", secs, len(got), f"{len(g)} vs {len(e)}; {g[:2]} | {e[:2]}"
    raw = sum(1 for a, b in zip(*(sorted(map(repr, (exact(cols, r) for r in rows))) for cols, rows in ((df.columns, got), (ecols, erows)))) if a != b)
    for a, b in zip(g, e):
        if not all(same(x, y) for x, y in zip(a, b)):
            return "VALUES", secs, len(got), f"\n   cols {gc}\n   spark {a}\n   duck  {b}"
    return ("ok" if g else "EMPTY"), secs, len(got), f"({raw} rows not bit-equal)" if raw else ""


def exact(cols, row):
    """Row with columns by name and values untouched, for the bit-equality note."""
    return tuple(v.isoformat() if hasattr(v, "isoformat") else v for _, v in sorted(zip(cols, row), key=lambda x: x[0]))


def main():
    from asofkit.registry import load_all
    from asofkit.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    reg = load_all()
    names = [n for n in reg if not args or any(a in n for a in args)]
    spark, con = local_session(), connect(sf)
    bad = []
    for n in names:
        try:
            st, secs, cnt, msg = compare(spark, con, reg[n], sf)
        except Exception as ex:  # report and go on with the next query
            st, secs, cnt, msg = "ERROR", 0.0, 0, str(ex)[:1500]
        print(f"{st:10s} {n:40s} {secs:6.2f}s {cnt:7d} {msg}", flush=True)
        if st not in ("ok", "rows-only"):
            bad.append(n)
    print(f"{len(names) - len(bad)}/{len(names)} good; bad: {bad}")


if __name__ == "__main__":
    main()
