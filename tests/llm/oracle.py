"""Compares a DataFrame with DuckDB's answer."""

from __future__ import annotations

import duckdb
import pandas as pd


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in frame.itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


def same_as_sql(df, sql: str, **tables: str | pd.DataFrame) -> None:
    con = duckdb.connect()
    for name, source in tables.items():
        if isinstance(source, str):
            con.execute(f"create view {name} as select * from '{source}'")
        else:
            con.register(name, source)
    want = con.execute(sql).fetch_df()
    got = df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
