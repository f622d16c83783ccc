"""Order-insensitive comparison of a Spark result with a DuckDB one."""

import math

import pandas as pd


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "\0"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


def rows(df):
    return sorted(tuple(_cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
