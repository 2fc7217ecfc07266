"""Run registered queries on Spark and on DuckDB and compare rows.

    python tools/check_queries.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from lectern.plans import registered  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = 0
    for name, fn in registered.QUERIES.items():
        if args.names and name not in args.names:
            continue
        try:
            t0 = time.time()
            df = fn(spark, args.sf)
            got = df.collect()
            t1 = time.time()
            if name not in registered.SQL:
                print(f"rows  {name}: {len(got)} rows, {t1 - t0:.2f}s", flush=True)
                continue
            cur = con.execute(registered.SQL[name])
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            t2 = time.time()
            a, b = rows_of(df.columns, got), rows_of(cols, want)
            types = {c: str(d[1]) for c, d in zip(cols, cur.description)}
            if sorted(df.columns) != sorted(cols):
                bad += 1
                print(f"FAIL  {name}: columns {sorted(df.columns)} / {sorted(cols)}", flush=True)
            elif a != b:
                bad += 1
                sa, sb = set(a), set(b)
                print(f"FAIL  {name}: {len(a)} / {len(b)} rows, only spark {len(sa - sb)}, only sql {len(sb - sa)}", flush=True)
                print("   cols ", sorted(cols))
                for r in sorted(sa - sb)[:3]:
                    print("   spark", str(r)[:400])
                for r in sorted(sb - sa)[:3]:
                    print("   sql  ", str(r)[:400])
            else:
                print(f"ok    {name}: {len(a)} rows, spark {t1 - t0:.2f}s, sql {t2 - t1:.2f}s {'' if got else '(EMPTY)'}", flush=True)
            dts = {f.name: f.dataType.simpleString() for f in df.schema}
            odd = {c: (dts.get(c), types[c]) for c in cols if ("HUGEINT" in types[c] or "DECIMAL" in types[c])}
            if odd:
                print("   types", odd)
        except Exception as exc:
            bad += 1
            print(f"ERROR {name}: {type(exc).__name__} {str(exc)[:1500]}", flush=True)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
