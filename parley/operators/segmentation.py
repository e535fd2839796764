"""Optimal segmentation of short series, and folds over segments of a timeline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MOST_SEGMENTS, LEAST_LENGTH = 8, 2


def best_cuts(x: np.ndarray, most: int = MOST_SEGMENTS, least: int = LEAST_LENGTH) -> list[int]:
    """Where to cut the rows of ``x`` so that squared error plus 2 * columns * ln(rows) per cut is least.

    Columns are put in standard units; those without variance don't count.
    """
    n = len(x)
    spread = x.std(0) if n else np.zeros(x.shape[1])
    z = (x[:, spread > 0] - x[:, spread > 0].mean(0)) / spread[spread > 0] if n else x
    if n < 2 * least or not z.shape[1]:
        return []
    one, two = (np.vstack([np.zeros(z.shape[1]), np.cumsum(v, 0)]) for v in (z, z * z))

    def error(i: int, j: int) -> float:
        return float((two[j] - two[i] - (one[j] - one[i]) ** 2 / (j - i)).sum())

    most = min(most, n // least)
    cost = np.full((most + 1, n + 1), np.inf)
    back = np.zeros((most + 1, n + 1), int)
    cost[0, 0] = 0
    for k in range(1, most + 1):
        for j in range(k * least, n + 1):
            options = [(cost[k - 1, i] + error(i, j), i) for i in range((k - 1) * least, j - least + 1)]
            cost[k, j], back[k, j] = min(options)
    penalty = 2 * z.shape[1] * np.log(n)
    k = int(np.argmin([cost[k, n] + penalty * (k - 1) for k in range(1, most + 1)])) + 1
    cuts, j = [], n
    while k > 1:
        j = int(back[k, j])
        cuts.append(j)
        k -= 1
    return cuts[::-1]


def segments(weekly: DataFrame, features: list[str], key: str = "conversation_id", week: str = "week") -> DataFrame:
    """``weekly(key, week, features)``, a row per key and week, to ``key, segment, first_week, last_week, weeks``.

    A key's weeks go to one task: a year has 52, whatever the number of messages.
    """

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(week)
        edges = [0, *best_cuts(rows[features].to_numpy(float)), len(rows)]
        found = [(rows[key].iat[0], i, rows[week].iat[a], rows[week].iat[b - 1], b - a) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
        return pd.DataFrame(found, columns=[key, "segment", "first_week", "last_week", "weeks"])

    return weekly.select(key, week, *features).groupBy(key).applyInPandas(cut, f"{key} long, segment long, first_week date, last_week date, weeks long")
