"""Run registered queries beside their SQL in DuckDB and compare the rows.

    python -m tests.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if type(x).__name__ == "Decimal":
        return float(x)
    return x


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str:
    """Empty when equal, otherwise what differs."""
    df = fn(spark, sf_dir)
    ours = canonical(df.columns, df.collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs = canonical(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(set(df.columns) ^ set(cols))}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        a, b = bad[0]
        names = sorted(cols)
        return f"{len(bad)}/{len(ours)} rows; first: " + "; ".join(
            f"{n}: {x!r} != {y!r}" for n, x, y in zip(names, a, b) if x != y)[:700]
    return ""


def main() -> int:
    import __spark_entry__ as e
    from tests.conftest import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    spark, con = build_session(), connect(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    failed = 0
    for name in args or qs:
        t0 = time.time()
        try:
            if name in sqls:
                out = compare(spark, con, qs[name], sqls[name], sf_dir)
            else:
                out = "" if qs[name](spark, sf_dir).count() >= 0 else "?"
        except Exception as ex:  # noqa: BLE001
            out = f"{type(ex).__name__}: {str(ex)[:900]}"
        failed += bool(out)
        print(f"{'FAIL' if out else 'ok  '} {name} {time.time() - t0:.1f}s {out}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
