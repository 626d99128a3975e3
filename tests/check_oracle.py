"""Compare every registered query with its check query: python tests/check_oracle.py [sf] [name...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402
from dwellmatch.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return f"{float(v):.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def compare(spark, con, sf_dir, name, run, sql) -> str:
    t0 = time.time()
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(rows)} ({t1 - t0:.1f}s)"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != cols:
        return f"MISMATCH columns {cols} / {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    took = f"({t1 - t0:.1f}s / {time.time() - t1:.1f}s)"
    if rows == want:
        return f"ok {len(rows)} {took}"
    a, b = set(rows), set(want)
    return f"MISMATCH {len(rows)}/{len(want)} {took} cols={cols}\n   spark: {sorted(a - b)[:3]}\n   sql:   {sorted(b - a)[:3]}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    d = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    checks, bad = E.oracle_sql(), 0
    for name, run in E.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            out = compare(spark, con, d, name, run, checks.get(name))
        except Exception as e:
            out = "FAILED " + str(e)[:400] + " | " + traceback.format_exc().splitlines()[-3][:200]
        bad += not out.startswith(("ok", "rows-only"))
        print(f"{name}: {out}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
