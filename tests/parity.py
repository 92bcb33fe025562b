"""Compare registered queries with their SQL counterparts: python tests/parity.py [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}".rstrip("0").rstrip(".").replace("-0", "-0") if v else "0"
    if hasattr(v, "normalize") and not hasattr(v, "hour"):
        f = float(v)
        return f"{f:.6f}".rstrip("0").rstrip(".") if f else "0"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    got = fn(spark, sf_dir)
    columns, rows = rows_of(got.columns, [tuple(r) for r in got.collect()])
    if sql is None:
        return True, f"rows only: {len(rows)}"
    cur = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if columns != want_columns:
        return False, f"columns {columns} vs {want_columns}"
    if rows == want:
        return True, f"{len(rows)} rows equal"
    a, b = set(rows) - set(want), set(want) - set(rows)
    return False, (
        f"rows {len(rows)} vs {len(want)}; only spark {len(a)} {str(sorted(a)[:2])[:500]}; "
        f"only sql {len(b)} {str(sorted(b)[:2])[:500]}"
    )


def main():
    from tablescout.plans import ORACLES, QUERIES
    from tablescout.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    if args and args[0].endswith("*"):
        names = [n for n in QUERIES if any(n.startswith(a.rstrip("*")) for a in args)]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), []
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:18s} {time.time() - start:6.2f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} ok; failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
