"""Exact tests of balance."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x >= 1, by Stirling's series from x + 8 downwards."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    return series - F.log(reduce(lambda a, i: a * (x + float(i)), range(1, 8), x))


def two_sided_binomial(rows: DataFrame, hits: str, trials: str) -> DataFrame:
    """``rows`` with ``p_value``: how likely a count as rare as ``hits`` of ``trials`` is at even odds.

    At even odds the rarer counts are those in both tails, so the value is twice the lower tail of the smaller side, at
    most 1. The tail is summed within a column from its largest term downwards, by the ratio of neighbouring terms; terms
    beyond twenty deviations are nothing, so that even a count of millions needs some thousand steps and no more rows.
    """
    n, k = F.col(trials).cast("double"), F.col(hits).cast("double")
    low = F.least(k, n - k)
    first = F.exp(log_gamma(n + 1) - log_gamma(low + 1) - log_gamma(n - low + 1) - n * math.log(2.0))
    steps = F.least(low, F.ceil(20 * F.sqrt(n)) + 40).cast("long")
    # the term of i is the one of i + 1 times (i + 1) / (n - i), for i from low - 1 downwards
    grow = lambda a, j: F.struct((a.w * (low - j + 1) / (n - low + j)).alias("w"), (a.s + a.w).alias("s"))
    tail = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), steps), F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")), grow, lambda a: a.s + a.w)).otherwise(1.0)
    value = F.when(2 * low == n, 1.0).otherwise(F.least(F.lit(1.0), 2 * first * tail))
    return rows.withColumn("p_value", F.when(n.isNotNull() & k.isNotNull(), value))


#: Sessions from which on a share tells anything, how likely a chance may be, and effects that are small and medium.
LEAST_SESSIONS, ALPHA, SMALL, MEDIUM = 5, 0.05, 0.2, 0.5


def initiative_bands(sessions: DataFrame) -> DataFrame:
    """``conversation_id, n, p_value, effect, band`` from ``sessions(conversation_id, initiator)``: who begins them.

    The effect is Cohen's h of the other side's share against one half. A share that may well be chance is balanced, as is a small effect.
    """
    counts = sessions.groupBy("conversation_id").agg(F.count("*").alias("n"), F.count_if(F.col("initiator") == 0).alias("theirs"))
    h = 2 * F.asin(F.sqrt(F.col("theirs") / F.col("n"))) - 2 * F.asin(F.sqrt(F.lit(0.5)))
    side = lambda word: F.when(F.col("effect") > 0, f"other {word}").otherwise(f"self {word}")
    band = F.when(F.col("n") < LEAST_SESSIONS, "insufficient").when((F.col("p_value") >= ALPHA) | (F.abs("effect") < SMALL), "balanced").when(F.abs("effect") < MEDIUM, side("leans")).otherwise(side("dominant"))
    return two_sided_binomial(counts, "theirs", "n").withColumn("effect", h).select("conversation_id", "n", "p_value", "effect", band.alias("band"))
