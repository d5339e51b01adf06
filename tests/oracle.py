"""Compares a Spark query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark, name, query, sql, sf_dir, con=None) -> str:
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    got = (con or connection(sf_dir)).execute(sql)
    theirs = rows([d[0] for d in got.description], got.fetchall())
    if mine[0] != theirs[0]:
        return f"{name}: columns {mine[0]} and {theirs[0]}"
    if mine[1] != theirs[1]:
        odd = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b][:3]
        return f"{name}: {len(mine[1])} and {len(theirs[1])} rows, such as {odd}"
    return ""
