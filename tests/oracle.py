"""Runs a registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
import warnings
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return str(value) if type(value).__module__ in ("datetime", "decimal") else value


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(df: DataFrame, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """Empty if both give the same rows, else what differs."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        cursor = con.cursor().execute(sql)
        names = [c[0] for c in cursor.description]
        want = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:2]}; only in SQL {list((want - got).items())[:2]}"
