"""Run a registered query in Spark and its oracle in DuckDB, and compare.

Mirrors the driver's check: row count, column names, and the multiset of rows
(order ignored).  Usable from tests and from the command line:

    python tests/harness.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

RAW_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split()


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for name in RAW_TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        if math.isnan(value):
            return (1, "nan")
        return (1, f"{value:.6f}")
    if isinstance(value, decimal.Decimal):
        return (1, f"{float(value):.6f}")
    if isinstance(value, bool):
        return (2, str(value))
    if isinstance(value, int):
        return (1, f"{float(value):.6f}")
    if isinstance(value, (dt.date, dt.datetime)):
        return (3, value.isoformat())
    return (4, str(value))


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(_norm(r[i]) for i in order) for r in rows]


def compare(spark, sf_dir: str, key: str, con=None, spark_df=None) -> dict:
    from shelfwise.plans.registry import named_queries, spark_callables
    q = named_queries()[key]
    t0 = time.time()
    df = spark_df if spark_df is not None else spark_callables()[key](spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    result = {"key": key, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 3)}
    if q.oracle is None:
        result["status"] = "rows-only"
        return result
    con = con or duckdb_connection(sf_dir)
    rel = con.execute(q.oracle)
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    result.update({"oracle_rows": len(d_rows), "oracle_sec": round(time.time() - t1, 3)})
    if sorted(s_cols) != sorted(d_cols):
        result["status"] = f"columns differ: spark={s_cols} oracle={d_cols}"
        return result
    a = sorted(normalise(s_cols, s_rows))
    b = sorted(normalise(d_cols, d_rows))
    if a == b:
        result["status"] = "match"
    else:
        extra = [r for r in a if r not in set(b)][:3]
        missing = [r for r in b if r not in set(a)][:3]
        result["status"] = f"values differ: spark-only={extra} oracle-only={missing}"
    return result


def main(argv):
    from shelfwise.session import build_session
    from shelfwise.plans.registry import named_queries
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:] or list(named_queries())
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duckdb_connection(sf_dir)
    bad = 0
    for key in keys:
        try:
            r = compare(spark, sf_dir, key, con)
        except Exception as exc:  # report and continue
            r = {"key": key, "status": f"error: {type(exc).__name__}: {str(exc)[:300]}"}
        ok = r["status"] in ("match", "rows-only")
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
