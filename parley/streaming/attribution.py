"""What became of suggestions: the user's own messages within a bounded time after each, in a batch and in a stream.

In a batch, suggestions meet messages by conversation and by cells of time as long as the window, so that a busy
conversation is spread over time. In a stream it is an interval join with watermarks on both sides; a suggestion without
any message comes out too, once its window has passed. Both end in the same columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a message begins that only announces another one.
PREFACES = ("对了", "等等", "还有", "我想说", "等下", "先说")


@dataclass(frozen=True)
class Limits:
    """Seconds a suggestion is followed, at most and at least before it counts as unrelated; characters of a preface; seconds between
    messages that count as one; likeness from which on a suggestion was accepted, or rewritten."""

    most_seconds: int = 600
    least_seconds: int = 180
    preface_chars: int = 8
    merge_gap: int = 90
    accepted: float = 0.90
    rewritten: float = 0.35
    preface_confidence: float = 0.70
    prefaces: tuple[str, ...] = PREFACES


LIMITS = Limits()
_OWN = "array<struct<ts_sec:bigint,id:bigint,content:string>>"


def _best(finals: pd.Series, speeches: pd.Series) -> pd.DataFrame:
    found = []
    for final, offered in zip(finals, speeches, strict=True):
        best, likeness = None, 0.0
        for speech in offered if final is not None and offered is not None else ():
            now = SequenceMatcher(None, final, speech or "").ratio()
            if now > likeness:
                best, likeness = speech, now
        found.append((best, round(likeness, 4)))
    return pd.DataFrame(found, columns=["speech", "likeness"])


def best_match(final: Column, speeches: Column) -> Column:
    """``speech, likeness`` of the first of the most alike ones by matching blocks; none and 0 if nothing matches."""
    return F.pandas_udf(_best, "speech string, likeness double")(final, speeches)


def is_preface(content: Column, limits: Limits = LIMITS) -> Column:
    return reduce(lambda a, p: a | F.startswith(content, F.lit(p)), limits.prefaces, F.length(content) <= limits.preface_chars)


def _judged(followed: DataFrame, limits: Limits) -> DataFrame:
    """``followed(suggestion_id, conversation_id, created_sec, now_sec, speeches, own, other_sec)`` to outcomes; without ``now_sec`` all windows are over."""
    n = F.size("own")
    first, last = F.get("own", F.lit(0)), F.element_at("own", -1)
    announces = (n >= 1) & is_preface(first["content"], limits)
    # messages close to one another are one; what counts is the last of them
    tail = F.aggregate(
        "own", F.struct(F.lit("").alias("content"), F.lit(None).cast("long").alias("at")),
        lambda a, x: F.struct(F.when(x["ts_sec"] - a["at"] <= limits.merge_gap, F.concat_ws(" ", a["content"], x["content"])).otherwise(x["content"]).alias("content"), x["ts_sec"].alias("at")),
    )["content"]
    final = F.when((n >= 2) & announces, last["content"]).when(n >= 1, tail)
    rows = followed.withColumn("own", F.array_sort(F.coalesce("own", F.array().cast(_OWN)))).withColumn("final_message", final)
    rows = rows.withColumn("best", best_match(F.col("final_message"), F.col("speeches")))
    age = F.col("now_sec") - F.col("created_sec")
    open_, young = F.coalesce(age < limits.most_seconds, F.lit(False)), F.coalesce(age < limits.least_seconds, F.lit(False))
    likeness = F.col("best.likeness")
    outcome = (
        F.when(F.col("other_sec").isNotNull() & ((n == 0) | (F.col("other_sec") < first["ts_sec"])), "interrupted").when((n == 0) & open_, "pending").when(n == 0, "low_confidence")
        .when((n == 1) & announces & open_, "pending").when((n >= 2) & announces, "preface_then_reply").when(likeness >= limits.accepted, "accepted")
        .when(likeness >= limits.rewritten, "rewritten").when(young, "pending").otherwise("unrelated")
    )
    rows = rows.withColumn("outcome", outcome)
    told = F.col("outcome").isin("preface_then_reply", "accepted", "rewritten", "unrelated")
    confidence = F.when(F.col("outcome") == "interrupted", 0.45).when(F.col("outcome") == "preface_then_reply", F.greatest(F.lit(limits.preface_confidence), likeness)).when(told, likeness).when(F.col("outcome") == "low_confidence", 0.0)
    keep = lambda c: F.when(told, c)
    return rows.select("suggestion_id", "conversation_id", "outcome", confidence.alias("confidence"), keep(F.col("best.speech")).alias("speech"), keep(F.col("final_message")).alias("final_message"))


def _spoken(messages: DataFrame) -> DataFrame:
    rows = messages.select(F.col("conversation_id").alias("of"), "id", "ts_sec", "sender", F.trim("content").alias("content"), *(["ts"] if "ts" in messages.columns else []))
    return rows.where((F.length("content") > 0) & (F.col("sender") != "system"))


def _sides() -> list[Column]:
    own = F.collect_list(F.when(F.col("sender") == "self", F.struct("ts_sec", "id", "content")))
    return [own.alias("own"), F.min(F.when(F.col("sender") != "self", F.col("ts_sec"))).alias("other_sec")]


def attributions(suggestions: DataFrame, messages: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """``suggestion_id, conversation_id, outcome, confidence, speech, final_message`` for each suggestion.

    ``suggestions`` are ``suggestion_id, conversation_id, created_sec, now_sec, speeches``, looked at as at ``now_sec`` (null: later than
    any window). ``messages`` are ``conversation_id, id, ts_sec, sender, content``; a sender is ``self``, ``system`` or somebody else.

    Somebody else's message first interrupts; no own message leaves little confidence; a short own message first and another one then is a
    preface and a reply; else the last own message, those close to it joined, is compared with the suggestion's speeches. What may still
    change is pending.
    """
    asked = suggestions.select("suggestion_id", F.col("conversation_id").alias("of"), "created_sec", F.least(F.col("created_sec") + limits.most_seconds, "now_sec").alias("until"))
    cell = (F.col("created_sec") / limits.most_seconds).cast("long")
    asked = asked.withColumn("cell", F.explode(F.array(cell, cell + 1)))
    spoken = _spoken(messages).withColumn("cell", (F.col("ts_sec") / limits.most_seconds).cast("long"))
    met = asked.join(spoken, ["of", "cell"]).where("ts_sec between created_sec and until").groupBy("suggestion_id").agg(*_sides())
    return _judged(suggestions.join(met, "suggestion_id", "left"), limits)


def attributions_stream(suggestions: DataFrame, messages: DataFrame, lateness: str = "10 minutes", limits: Limits = LIMITS) -> DataFrame:
    """The same over two streams, whose rows also have their times as ``created`` and ``ts``; each suggestion comes out once, when the
    watermark has passed its window, so that none is pending. Keys' state goes when that has happened."""
    asked = suggestions.withWatermark("created", lateness).select("suggestion_id", "conversation_id", "created", "created_sec", "speeches")
    spoken = _spoken(messages).withWatermark("ts", lateness)
    within = F.expr(f"conversation_id = of and ts >= created and ts <= created + interval {limits.most_seconds} seconds")
    met = asked.join(spoken, within, "left_outer").groupBy("suggestion_id", "conversation_id", "created").agg(F.first("created_sec").alias("created_sec"), F.first("speeches").alias("speeches"), *_sides())
    return _judged(met.withColumn("now_sec", F.lit(None).cast("long")), limits)
