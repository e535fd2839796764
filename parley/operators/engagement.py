"""What one pass over a conversation's texts tells of both sides' engagement.

Runs and pauses are scanned per day with carried rows (:mod:`parley.operators.timeline`); greetings and daily numbers come from
an aggregate per day. Both are small before they are added up per conversation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.lexicon import CHAT, OWN_NAME, RECALL, Words
from parley.operators import timeline

#: Messages of a run without an answer; seconds of a long pause and of one that an ice-break ends; a longer one counts as absence.
BURST, LONG_PAUSE, ICE_BREAK, ABSENCE = 3, 7_200, 86_400, 864_000
#: Hours whose beginning lies in the depth of night.
DEEP_NIGHT = (2, 3, 4, 5, 6)
TEXT, SYSTEM = 1, 10_000
SIDES = ((1, "self"), (0, "other"))


def texts_of(messages: DataFrame) -> DataFrame:
    """Text messages that aren't blank, trimmed."""
    return messages.where(F.col("message_type") == TEXT).withColumn("content", F.trim("content")).where("content <> ''")


def spans_deep_night(start: Column, end: Column) -> Column:
    """Whether the beginning of an hour of deep night lies between two moments (epoch seconds), or they are too far apart to tell."""
    inside = reduce(lambda a, b: a | b, (F.floor((end - 1 - h * 3600) / 86_400) > F.floor((start - h * 3600) / 86_400) for h in DEEP_NIGHT))
    return (end - start > ABSENCE) | inside


def greeting(content: Column, words: Words, kind: str) -> Column:
    """Whether a short text is a greeting of the morning or the night."""
    prefixes = words.morning if kind == "morning" else words.night
    found = reduce(lambda a, b: a | b, (content.startswith(p) for p in prefixes), F.lit(False))
    if kind == "morning" and words.morning_exact:
        found = found | content.isin(*words.morning_exact)
    return found & (F.length(content) <= words.greeting_chars)


def perfunctory(content: Column, words: Words = CHAT) -> Column:
    """Whether a reply is half-hearted: listed, or very short, and none of the short ones that are warm."""
    return ~content.isin(*words.engaged) & (content.isin(*words.perfunctory) | (F.length(content) <= words.short_chars)) & (content != "")


def engagement(messages: DataFrame, words: Words = CHAT) -> DataFrame:
    """One row per conversation with texts: ``n_texts, days, variation`` and for each side (``_self, _other``) ``texts, bursts``
    (runs of three or more until the other side writes or the data end), ``long_unanswered`` (pauses of more than two hours
    without deep night that this side ends), ``ice_breaks`` (of more than a day), ``mornings, nights`` (days with a greeting),
    ``togetherness`` (shared among all first persons, null without any) and ``perfunctory`` (share of texts).

    Null and blank texts don't count; ties in time go by id; a table without rows gives none.
    """
    texts = timeline.with_day(texts_of(messages))
    key, order = ["conversation_id"], ["ts", "id"]
    linked = timeline.with_runs(texts, "run", ["is_sender", "ts_sec"], F.col("prev_is_sender") != F.col("is_sender"), key, order)
    gap, switch = F.col("ts_sec") - F.col("prev_ts_sec"), F.coalesce(F.col("prev_is_sender") != F.col("is_sender"), F.lit(False))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    runs = linked.groupBy("conversation_id", "run", "is_sender").agg(
        F.count("*").alias("n"), count(switch & (gap > ICE_BREAK)).alias("ice"),
        count(switch & (gap > LONG_PAUSE) & (gap <= ICE_BREAK) & ~spans_deep_night(F.col("prev_ts_sec"), F.col("ts_sec"))).alias("late"),
        F.sum(F.regexp_count("content", F.lit(words.together))).alias("we"), F.sum(F.regexp_count("content", F.lit(words.alone))).alias("i"),
        count(perfunctory(F.col("content"), words)).alias("dull"),
    )
    per_side = []
    for side, name in SIDES:
        of = lambda c, side=side: F.sum(F.when(F.col("is_sender") == side, c).otherwise(0))
        refs = of(F.col("we")) + of(F.col("i"))
        per_side += [
            of(F.col("n")).alias(f"texts_{name}"), of((F.col("n") >= BURST).cast("long")).alias(f"bursts_{name}"), of(F.col("late")).alias(f"long_unanswered_{name}"), of(F.col("ice")).alias(f"ice_breaks_{name}"),
            F.round(F.when(refs > 0, of(F.col("we")) / refs), 4).alias(f"togetherness_{name}"), F.when(of(F.col("n")) > 0, of(F.col("dull")) / of(F.col("n"))).otherwise(0.0).alias(f"perfunctory_{name}"),
        ]
    of_runs = runs.groupBy("conversation_id").agg(F.sum("n").alias("n_texts"), *per_side)
    said = [F.max(F.when((F.col("is_sender") == side) & greeting(F.col("content"), words, kind), 1).otherwise(0)).alias(f"{kind}s_{name}") for side, name in SIDES for kind in ("morning", "night")]
    days = texts.groupBy("conversation_id", "day").agg(F.count("*").alias("n"), *said)
    variation = F.when(F.count("*") >= 2, F.round(F.stddev_pop("n") / F.avg("n"), 4))
    of_days = days.groupBy("conversation_id").agg(F.count("*").alias("days"), variation.alias("variation"), *(F.sum(f"{kind}s_{name}").alias(f"{kind}s_{name}") for _, name in SIDES for kind in ("morning", "night")))
    return of_runs.join(of_days, "conversation_id")


def recalls(messages: DataFrame, pattern: str = RECALL, own: tuple[str, ...] = OWN_NAME) -> DataFrame:
    """``conversation_id, mine, theirs``: recalls that system rows tell of; the pattern's first group is who recalled."""
    who = F.regexp_extract("content", pattern, 1)
    rows = messages.where(F.col("message_type") == SYSTEM).where(F.col("content").rlike(pattern)).withColumn("_own", who.isin(*own))
    return rows.groupBy("conversation_id").agg(F.count_if(F.col("_own")).alias("mine"), F.count_if(~F.col("_own")).alias("theirs"))


def cooling(messages: DataFrame, least_days: int = 6) -> DataFrame:
    """``conversation_id, early, recent``: mean texts a day in the first and the last third of the active days, from six days on."""
    days = timeline.with_day(texts_of(messages)).groupBy("conversation_id", "day").agg(F.count("*").alias("n"))
    over = Window.partitionBy("conversation_id")
    placed = days.withColumns({"k": F.row_number().over(over.orderBy("day")), "days": F.count("*").over(over)}).withColumn("third", F.floor(F.col("days") / 3)).where(F.col("days") >= least_days)
    mean = lambda c: F.avg(F.when(c, F.col("n")))
    return placed.groupBy("conversation_id").agg(mean(F.col("k") <= F.col("third")).alias("early"), mean(F.col("k") > F.col("days") - F.col("third")).alias("recent"))
