"""Run a registered query and its SQL side by side and compare rows, names and values."""

import glob
import os

import duckdb

TESTDATA = "/root/testdata"


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(row[i] for i in order) for row in cursor.fetchall()]
    return sorted(names), sorted(rows, key=repr)


def difference(spark, con, sf_dir, query, sql):
    """None when equal, else a short description."""
    names, left = spark_rows(query(spark, sf_dir))
    expected, right = sql_rows(con, sql)
    if names != expected:
        return f"columns {names} != {expected}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows: {left[:3]} | {right[:3]}"
    if left == right and repr(left) == repr(right):
        return "no rows at all" if not left else None
    bad = [(a, b) for a, b in zip(left, right) if repr(a) != repr(b)]
    return f"{len(bad)} of {len(left)} rows differ: {bad[:3]}"
