"""Spark rows against DuckDB rows on the same Parquet tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.9g}"
    return str(v)


def rows_of(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


def duck(sql: str, folder: str = SF) -> pd.DataFrame:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else p / '*.parquet'}'")
    return con.execute(sql).df()


def assert_same(df, sql: str, folder: str = SF) -> None:
    got, want = df.toPandas(), duck(sql, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
