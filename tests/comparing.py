"""Spark results against DuckDB SQL over the same Parquet tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd


def duck(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p / '*.parquet' if os.path.isdir(p) else p}')")
    return con


def value(v):
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    return round(v, 6) if isinstance(v, float) else v


def rows(df: pd.DataFrame) -> list[str]:
    return sorted(repr(tuple(value(x) for x in r)) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark_df, con, sql: str) -> None:
    got, want = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
