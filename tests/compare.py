"""Holds a query against its SQL in DuckDB: row count, column names and values, whatever the order."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal) or isinstance(x, float):
        return float(f"{float(x):.9g}") if math.isfinite(x) else str(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x.isoformat() if isinstance(x, datetime.date) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(r[i]) for i in order] for r in data), key=repr)


def differences(spark_df, con, sql):
    got = con.execute(sql)
    want = rows([d[0] for d in got.description], got.fetchall())
    have = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if want[0] != have[0]:
        return f"columns {have[0]} for {want[0]}"
    bad = [(a, b) for a, b in zip(have[1], want[1]) if a != b]
    return f"{len(have[1])} rows for {len(want[1])}, {len(bad)} differ: {bad[:2]}" if bad or len(have[1]) != len(want[1]) else ""
