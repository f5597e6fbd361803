"""Compares a query's rows with DuckDB's."""

from __future__ import annotations

import duckdb
import pandas as pd

from assaymill.sources.tables import NAMES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return None if value is None or pd.isna(value) else value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(map(plain, r)) for r in frame.itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))
