"""Query results against DuckDB's over the same files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(df, con, sql):
    """Empty if names, kinds and rows agree, else what differs."""
    want = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(want.columns):
        return f"columns {names} against {sorted(want.columns)}"
    mine = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=key)
    at = [want.columns.index(c) for c in names]
    theirs = sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=key)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    spark_types = dict(df.dtypes)
    for c, i in zip(names, at):
        kind = str(want.types[i])
        ours = spark_types[c]
        same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}.get(ours, kind)
        if same != kind:
            return f"{c} is {ours} against {kind}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{a} against {b}"
    return ""
