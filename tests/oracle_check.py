"""Local stand-in for the driver's correctness gate.

Runs each registered Spark query and its DuckDB oracle on the same parquet
tables and compares row count, column names and order-insensitive values.
Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from encore.session import build_session  # noqa: E402
from encore.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, repr(v))
    if hasattr(v, "isoformat"):
        return (3, v.isoformat())
    return (4, repr(v))


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    pdf = sdf.collect()
    t1 = time.time()
    s_cols = sdf.columns
    s_types = [f.dataType.simpleString() for f in sdf.schema.fields]
    if sql is None:
        return dict(name=name, ok=None, rows=len(pdf), spark_s=round(t1 - t0, 2))
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_types = [str(c[1]) for c in res.description]
    drows = res.fetchall()
    out = dict(name=name, rows=len(pdf), oracle_rows=len(drows), spark_s=round(t1 - t0, 2))
    if sorted(s_cols) != sorted(d_cols):
        out.update(ok=False, why=f"columns {s_cols} vs {d_cols}")
        return out
    a = rows_of(s_cols, [tuple(r) for r in pdf])
    b = rows_of(d_cols, drows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        out.update(ok=False, why=f"values differ: {diff}; types {list(zip(s_cols, s_types))} vs {list(zip(d_cols, d_types))}")
        return out
    out.update(ok=True, types=list(zip(s_cols, s_types, d_types)))
    return out


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    filters = [a for a in args if not a.startswith("/")]
    import __spark_entry__ as E

    spark = build_session("local[8]", shuffle_partitions=8, extra_conf={"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if filters and not any(name.startswith(f) for f in filters):
            continue
        try:
            r = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and go on
            r = dict(name=name, ok=False, why=f"{type(e).__name__}: {str(e)[:600]}")
        if r.get("ok") is False:
            bad += 1
        types = r.pop("types", None)
        print(r, flush=True)
        if types and os.environ.get("SHOW_TYPES"):
            print("   ", types)
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
