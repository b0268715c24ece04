"""Run registered queries next to their SQL and compare the rows.

    python -m tests.compare [--sf 0.01] [--chunk rows] [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback
from decimal import Decimal

import duckdb

ROOT = "/root/testdata"


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when both give the same rows, else a short description."""
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            bad = sum(1 for p, q in zip(a, b) if p != q)
            return f"{sorted(got_cols)} {x} != {y} ({bad} rows differ)"
    return None


def main(argv: list[str]) -> int:
    from trajlens.plans import ORACLES, QUERIES
    from trajlens.sequence import CHUNK_SETTING
    from trajlens.session import build_session

    sf, chunk = "0.01", None
    while argv[:1] in (["--sf"], ["--chunk"]):
        if argv[0] == "--sf":
            sf = argv[1]
        else:
            chunk = argv[1]
        argv = argv[2:]
    spark = build_session("compare", "local[8]")
    if chunk:
        spark.conf.set(CHUNK_SETTING, chunk)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(f"{ROOT}/sf{sf}")
    names = [n for n in QUERIES if not argv or any(n.startswith(a) for a in argv)]
    failed = []
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, f"{ROOT}/sf{sf}")
            if name in ORACLES:
                problem = difference(df, con, ORACLES[name])
                note = "same" if problem is None else problem
            else:
                problem, n = None, len(df.collect())
                note = f"no sql, {n} rows"
        except Exception as e:
            problem = note = f"{type(e).__name__}: {str(e)[:700]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {name:38s} {time.time() - start:6.2f}s  {note}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} fine; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
