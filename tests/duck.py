"""Run a registered query in Spark and its SQL in DuckDB, and compare whole results."""

import math

import duckdb

from boxlake.plans import load_all
from boxlake.plans.registry import ORACLES, QUERIES, TABLES

load_all()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def order(row):
    return tuple((x is None, "" if isinstance(x, (int, float)) else str(type(x)), 0 if x is None else x) for x in row)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def spark_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=order)


def duck_rows(con, name):
    r = con.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    cols = sorted(names)
    pos = [names.index(c) for c in cols]
    return cols, sorted((tuple(plain(row[i]) for i in pos) for row in r.fetchall()), key=order)
