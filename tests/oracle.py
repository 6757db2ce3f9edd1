"""A query's Spark rows against its SQL on the same tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(value(x) for x in v)
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 9))
    return str(v)


def rows(frame: pd.DataFrame, columns: list[str]) -> list:
    return sorted((tuple(value(v) for v in r) for r in frame[columns].itertuples(index=False)), key=str)


def same(spark, query, sql: str, folder: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, wanted = query(spark, folder).toPandas(), con.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    assert rows(got, columns) == rows(wanted, columns)
