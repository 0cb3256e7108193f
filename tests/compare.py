"""Rows of two frames, whatever their order and their columns' order."""

import math

import pandas as pd


def cell(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, str):
        return v
    try:
        return float(f"{float(v):.12g}")
    except (TypeError, ValueError):
        return str(v)


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None)), key=repr)
