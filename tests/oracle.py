"""Runs queries in Spark and their SQL in DuckDB over the same files, and compares rows by column name."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, datetime.datetime | datetime.date):
        return str(value)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    return con


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both have the same rows."""
    names = sorted(df.columns)
    ours = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    result = con.sql(sql)
    theirs_names = list(result.columns)
    if sorted(theirs_names) != names:
        return f"columns {names} and {sorted(theirs_names)}"
    at = [theirs_names.index(n) for n in names]
    theirs = Counter(tuple(plain(r[k]) for k in at) for r in result.fetchall())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:2]}, only theirs {list((theirs - ours).items())[:2]} of {names}"


def folder(name: str) -> str:
    path = f"{os.environ.get('TEST_SF_DIR', '/root/testdata')}/{name}"
    return path if glob.glob(f"{path}/*") else ""
