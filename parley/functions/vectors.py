"""Vectors packed as half-precision numbers behind a magic word."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the storage format.
MAGIC = b"CTV1"


def _packed(vectors: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else MAGIC + np.asarray(v, "<f2").tobytes() for v in vectors], dtype=object)


def _unpacked(data: pd.Series) -> pd.Series:
    good = lambda d: d is not None and bytes(d[:4]) == MAGIC and len(d) % 2 == 0
    return pd.Series([np.frombuffer(bytes(d)[4:], "<f2").astype(np.float32).tolist() if good(d) else [] for d in data], dtype=object)


def pack(vector: Column | str) -> Column:
    """Null for a null."""
    return F.pandas_udf(_packed, "binary")(vector)


def unpack(data: Column | str) -> Column:
    """An empty vector for nulls and for what isn't packed so."""
    return F.pandas_udf(_unpacked, "array<float>")(data)
