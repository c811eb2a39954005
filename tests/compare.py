"""Order-insensitive comparison of a Spark result with its SQL counterpart."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if hasattr(value, "item"):
        return _cell(value.item())
    if isinstance(value, pd.Timestamp) or hasattr(value, "isoformat"):
        return str(pd.Timestamp(value))
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    ordered = frame[sorted(frame.columns)].astype(object)
    cells = [tuple(_cell(v) for v in row) for row in ordered.itertuples(index=False)]
    return sorted(cells, key=lambda r: tuple((v is not None, str(v)) for v in r))


def differences(actual: pd.DataFrame, expected: pd.DataFrame) -> list[str]:
    if sorted(actual.columns) != sorted(expected.columns):
        return [f"columns {sorted(set(actual.columns) ^ set(expected.columns))}"]
    got, want = rows(actual), rows(expected)
    found = []
    if len(got) != len(want):
        found.append(f"rows {len(got)} != {len(want)}")
    pairs = [(g, w) for g, w in zip(got, want, strict=False) if g != w]
    names = sorted(actual.columns)
    for g, w in pairs[:3]:
        found.append(str([(n, a, b) for n, a, b in zip(names, g, w, strict=True) if a != b][:6]))
    return found
