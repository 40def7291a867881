"""Run queries on Spark and their SQL on DuckDB and compare all rows.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def cell(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(glob.glob(f"{folder}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def kind(t) -> str:
    t = str(t).lower()
    for names, out in ((("double", "float", "decimal"), "float"), (("bigint", "int", "long", "hugeint"), "int"), (("string", "varchar"), "str")):
        if any(n in t for n in names):
            return out
    return t


def compare(spark, con, folder, name, fn, sql):
    """(ok, detail, seconds, rows)"""
    start = time.time()
    df = fn(spark, folder)
    got = df.collect()
    seconds = time.time() - start
    if sql is None:
        return len(got) > 0, "rows only", seconds, len(got)
    rel = con.execute(sql)
    names, types = [d[0] for d in rel.description], [str(d[1]) for d in rel.description]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", seconds, len(got)
    mine = dict((f.name, kind(f.dataType.simpleString())) for f in df.schema.fields)
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"{len(a)} vs {len(b)} rows; {len([1 for x, y in zip(a, b) if x != y])} differ; e.g. {diff}", seconds, len(got)
    return True, "", seconds, len(got)


def main():
    from pyspark.sql import SparkSession

    from tabsense.plans.catalog import QUERIES, SQL

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    bad = 0
    for name in chosen:
        try:
            ok, detail, seconds, n = compare(spark, con, folder, name, QUERIES[name], SQL.get(name))
        except Exception as e:
            ok, detail, seconds, n = False, f"{type(e).__name__}: {str(e)[:600]}", 0.0, 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {seconds:7.2f}s {n:8d} rows {detail}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} ok")


if __name__ == "__main__":
    main()
