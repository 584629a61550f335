"""Rows of two engines, compared without their order."""

import math


def cell(v):
    kind = type(v).__name__
    if v is None or kind in ("NAType", "NaTType"):
        return "null"
    if kind in ("bool", "bool_"):
        return str(bool(v))
    if kind in ("ndarray", "list"):
        return str([cell(x) for x in v])
    try:
        x = float(v)
    except (TypeError, ValueError):
        return str(v)
    return "null" if x != x else f"{x:.6f}" if math.isfinite(x) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))
