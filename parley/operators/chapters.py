"""Chapters of a conversation: weeks of a kind, where they change and by what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.operators import segmentation, timeline
from parley.operators.engagement import texts_of

KEY = "conversation_id"
FEATURES = ["volume", "other_share", "pos_ratio", "latency"]
#: Weeks from which on chapters are looked for, and deviations from which on a change is told.
LEAST_WEEKS, LEAST_SHIFT = 12, 0.5
WEEK = 7 * 86_400


def weekly_features(messages: DataFrame, moods: DataFrame) -> DataFrame:
    """``conversation_id, week, n, first_sec, last_sec`` and the features, a row for every week from the first to the last one with texts.

    ``volume`` is the logarithm of one more than the texts, ``other_share`` the other side's share of them (one half in an empty week), ``pos_ratio`` the positive
    ones among those with a polarity, ``latency`` the logarithm of one more than the mean minutes until a reply. What a week lacks is the mean of the
    conversation's other weeks, or 0 where none has it. ``moods`` are ``message_id, polarity``.
    """
    week = lambda c: F.to_date(F.date_trunc("week", c))
    texts = texts_of(messages).withColumn("week", week("ts")).join(moods.select(F.col("message_id").alias("id"), "polarity"), "id", "left")
    found = texts.groupBy(KEY, "week").agg(
        F.count("*").alias("n"), F.min("ts_sec").alias("first_sec"), F.max("ts_sec").alias("last_sec"), F.count_if(F.col("is_sender") == 0).alias("theirs"),
        F.count_if(F.col("polarity") == 1).alias("good"), F.count_if(F.col("polarity") == -1).alias("bad"),
    )
    replies = timeline.response_times(messages).groupBy(KEY, week("ts").alias("week")).agg(F.avg("response_sec").alias("seconds"))
    weeks = found.groupBy(KEY).agg(F.explode(F.sequence(F.min("week"), F.max("week"), F.expr("interval 7 days"))).alias("week"))
    rows = weeks.join(found, [KEY, "week"], "left").join(replies, [KEY, "week"], "left").na.fill(0, ["n", "theirs", "good", "bad"])
    raw = {
        "volume": F.log1p(F.col("n")), "other_share": F.when(F.col("n") > 0, F.col("theirs") / F.col("n")).otherwise(0.5),
        "pos_ratio": F.when(F.col("good") + F.col("bad") > 0, F.col("good") / (F.col("good") + F.col("bad"))), "latency": F.log1p(F.col("seconds") / 60),
    }
    rows = rows.select(KEY, "week", "n", "first_sec", "last_sec", *(c.alias(k) for k, c in raw.items()))
    mean = lambda k: F.avg(k).over(Window.partitionBy(KEY))  # a row per week
    return rows.select(KEY, "week", "n", "first_sec", "last_sec", *(F.coalesce(k, mean(k), F.lit(0.0)).alias(k) for k in FEATURES))


def chapters(weekly: DataFrame, least_weeks: int = LEAST_WEEKS, least_shift: float = LEAST_SHIFT) -> DataFrame:
    """``conversation_id, chapter, first_week, last_week, weeks, n, from_sec, to_sec, changes`` of conversations with enough weeks.

    The cuts are those of the least squared error with a penalty for each (see :func:`segmentation.best_cuts`). ``changes`` are ``feature, delta`` for the features
    whose mean differs from the chapter's before by enough of the conversation's standard deviations; a feature that doesn't vary never does. A chapter without
    texts lasts from its first week's beginning to its last one's end.
    """
    own = Window.partitionBy(KEY)
    long = weekly.withColumn("_weeks", F.count("*").over(own)).where(F.col("_weeks") >= least_weeks).drop("_weeks")
    cuts = segmentation.segments(long, FEATURES)
    spread = {f"_{k}": F.stddev_pop(k).over(own) for k in FEATURES}
    placed = long.withColumns(spread).join(cuts, KEY).where(F.col("week").between(F.col("first_week"), F.col("last_week")))
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    stats = placed.groupBy(KEY, "segment", "first_week", "last_week", "weeks").agg(
        F.sum("n").alias("n"), F.coalesce(F.min("first_sec"), seconds(F.min("week"))).alias("from_sec"), F.coalesce(F.max("last_sec"), seconds(F.max("week")) + WEEK - 1).alias("to_sec"),
        *(F.avg(k).alias(k) for k in FEATURES), *(F.max(k).alias(k) for k in spread),
    )
    order = own.orderBy("segment")
    delta = lambda k: F.when(F.col(f"_{k}") > 1e-6, (F.col(k) - F.lag(k).over(order)) / F.col(f"_{k}"))
    told = stats.withColumns({f"_d_{k}": delta(k) for k in FEATURES})
    changes = F.array(*(F.struct(F.lit(k).alias("feature"), F.round(F.col(f"_d_{k}"), 2).alias("delta"), F.col(f"_d_{k}").alias("exact")) for k in FEATURES))
    kept = F.transform(F.filter(changes, lambda x: F.abs(x["exact"]) >= least_shift), lambda x: F.struct(x["feature"].alias("feature"), x["delta"].alias("delta")))
    return told.select(KEY, F.col("segment").alias("chapter"), "first_week", "last_week", "weeks", "n", "from_sec", "to_sec", kept.alias("changes"))


def spans(found: DataFrame, messages: DataFrame) -> DataFrame:
    """``conversation_id, chapter, from_sec, to_sec, whole``: the chapters where there are any, else one span over all texts."""
    texts = texts_of(messages).groupBy(KEY).agg(F.min("ts_sec").alias("from_sec"), F.max("ts_sec").alias("to_sec"))
    rest = texts.join(found.select(KEY).distinct(), KEY, "left_anti").select(KEY, F.lit(0).cast("long").alias("chapter"), "from_sec", "to_sec", F.lit(True).alias("whole"))
    return found.select(KEY, "chapter", "from_sec", "to_sec", F.lit(False).alias("whole")).unionByName(rest)
