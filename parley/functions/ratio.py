"""Similarity of two strings by matching blocks."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def matching_ratio(a: Column, b: Column) -> Column:
    """Twice the matching characters over both lengths, 0 to 1; null if either is null."""
    return F.pandas_udf(_ratios, "double")(a, b)
