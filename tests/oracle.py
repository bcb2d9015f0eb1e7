"""Run a query and its SQL side by side."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _cell(x) -> str:
    if hasattr(x, "tolist") or isinstance(x, (list, tuple)):
        return str(list(x))
    if x is None or pd.isna(x):
        return "NULL"
    if isinstance(x, float):
        return repr(int(x)) if x == int(x) else repr(round(x, 9))
    return str(x)


def canonical(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(zip(*[df[c].map(_cell) for c in sorted(df.columns)]))


def same(spark_df, sql: str, sf_dir: str) -> None:
    got, want = spark_df.toPandas(), tables(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
