"""Run a registered Spark query and its DuckDB oracle on the same tables and
compare them: row count, column names, and an order-insensitive value hash.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v  # exact: both engines must produce the same double
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def table_hash(cols, rows) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, sf_dir, key, con=None, verbose=True):
    import __spark_entry__ as E

    con = con or duck_connection(sf_dir)
    t0 = time.time()
    sdf = E.queries()[key](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    sql = E.oracle_sql().get(key)
    if sql is None:
        if verbose:
            print(f"{key}: spark rows={len(srows)} ({t1 - t0:.1f}s), no oracle")
        return None
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    ok_rows = len(srows) == len(drows)
    ok_cols = sorted(scols) == sorted(dcols)
    ok_vals = ok_cols and table_hash(scols, srows) == table_hash(dcols, drows)
    if verbose:
        print(f"{key}: rows {len(srows)}/{len(drows)} cols {'ok' if ok_cols else (scols, dcols)} "
              f"values {'ok' if ok_vals else 'DIFF'} (spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s)")
    return ok_rows and ok_cols and ok_vals, (scols, srows, dcols, drows)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from quire.session import get_session
    import __spark_entry__ as E

    spark = get_session("local[8]", shuffle_partitions=8)
    keys = argv[2:] or list(E.queries())
    con = duck_connection(sf_dir)
    bad = []
    for k in keys:
        try:
            r = compare(spark, sf_dir, k, con)
            if r is not None and not r[0]:
                bad.append(k)
        except Exception as e:  # report and continue
            print(f"{k}: ERROR {type(e).__name__}: {str(e)[:400]}")
            bad.append(k)
    print("FAILED:", bad)


if __name__ == "__main__":
    main(sys.argv)
