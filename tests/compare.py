"""Run one registered query in Spark and its SQL in DuckDB and compare rows without regard to order."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb
import numpy as np


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    """A comparable form of one value."""
    if value is None:
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, Decimal):
        return round(float(value), 9)
    if isinstance(value, (float, np.floating)):
        return None if math.isnan(value) else round(float(value), 9) + 0.0
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None).isoformat()
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, [tuple(plain(row[n]) for n in names) for row in df.collect()]


def duck_rows(connection, text):
    result = connection.execute(text)
    columns = [d[0] for d in result.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, [tuple(plain(row[i]) for i in at) for row in result.fetchall()]


def key(row):
    return tuple((v is None, type(v).__name__ if not isinstance(v, (int, float)) else "n", str(v)) for v in row)


def difference(df, connection, text) -> str | None:
    names, mine = spark_rows(df)
    other_names, theirs = duck_rows(connection, text)
    if names != other_names:
        return f"columns {sorted(set(names) ^ set(other_names))}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} against {len(theirs)}"
    mine.sort(key=key)
    theirs.sort(key=key)
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if not wrong:
        return None
    a, b = wrong[0]
    fields = [(n, x, y) for n, x, y in zip(names, a, b) if x != y][:4]
    return f"{len(wrong)} of {len(mine)} rows differ, first {fields}"
