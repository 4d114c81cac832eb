"""Comparison of a query with its SQL, by rows without order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf: str = SF) -> duckdb.DuckDBPyConnection:
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return out


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows(columns: list[str], found) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(repr(tuple(plain(r[i]) for i in order)) for r in found)


def same(spark_df, db: duckdb.DuckDBPyConnection, sql: str) -> None:
    answer = db.sql(sql)
    assert sorted(answer.columns) == sorted(spark_df.columns)
    mine, theirs = rows(spark_df.columns, spark_df.collect()), rows(answer.columns, answer.fetchall())
    assert mine == theirs, (list((mine - theirs))[:3], list((theirs - mine))[:3])
