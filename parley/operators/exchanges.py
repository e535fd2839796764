"""What several scores of one timeline need, each computed once: units, sessions, pairs of units, statistics, engagement.

A unit's row holds what its messages say and feel, its session and the unit before, so that no score gathers messages or
looks for neighbours again. Units and pairs are written once, and what reads them starts from there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.lexicon import CHAT, Words
from parley.functions.numbers import cosine
from parley.operators import timeline
from parley.operators.engagement import engagement
from parley.operators.lineage import staged

STICKER = 47
KEY = "conversation_id"


def _has(words: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower("content").rlike("|".join(map(re.escape, words))), F.lit(False)) if words else F.lit(False)


@dataclass
class Exchanges:
    """``messages``; ``moods`` are ``message_id, intensity``; ``vectors`` are ``vec_id, embedding``, taken by a unit's first message. Moods beyond ``cut``
    have a polarity. ``soft``, ``engaged`` and ``liked`` are words of messages.
    """

    messages: DataFrame
    vectors: DataFrame | None = None
    moods: DataFrame | None = None
    soft: tuple[str, ...] = ()
    engaged: tuple[str, ...] = ()
    liked: tuple[str, ...] = ()
    words: Words = CHAT
    cut: float = 0.3

    def _said(self) -> DataFrame:
        """A row per message id: how many messages have it, what they hold, and its moods. Ids should be unique, but need not be."""
        liked = tuple(k.strip().lower() for k in self.liked if k.strip())
        said = self.messages.where("id is not null").select("id", _has(self.soft).alias("soft"), _has(self.engaged).alias("engaged"), _has(liked).alias("liked"))
        said = said.groupBy("id").agg(F.count("*").alias("n"), *(F.bool_or(c).alias(c) for c in ("soft", "engaged", "liked")))
        if self.moods is None:
            return said.select("id", "liked")
        felt = self.moods.groupBy(F.col("message_id").alias("id")).agg(
            F.count("*").alias("moods"), F.count("intensity").alias("known"), F.sum("intensity").alias("intensity"),
            F.count_if(F.col("intensity") > self.cut).alias("good"), F.count_if(F.abs("intensity") > self.cut).alias("polar"),
        )
        return said.join(felt, "id", "left")

    @cached_property
    def units(self) -> DataFrame:
        """Units with ``first_id, liked, session_id, prev_session_id`` and the former unit's columns as ``prev_...``; with moods also how many there are
        (``moods``), their mean (``level``), ``soft``, ``engaged``, and how many are ``good`` or ``polar``.
        """
        starts = (F.col("prev_is_sender") != F.col("is_sender")) | (F.col("ts_sec") - F.col("prev_ts_sec") >= timeline.UNIT_GAP)
        rows = timeline.with_day(self.messages.select(KEY, "id", "ts", "ts_sec", "is_sender", F.length("content").alias("n_chars")))
        numbered = timeline.with_runs(rows, "unit_id", ["is_sender", "ts_sec"], starts, [KEY], ["ts", "id"]).join(self._said(), "id", "left")
        felt, carried = [], []
        if self.moods is not None:
            there = F.col("moods") > 0
            felt = [
                F.coalesce(F.sum(F.col("n") * F.col("moods")), F.lit(0)).alias("moods"), (F.sum(F.col("n") * F.col("intensity")) / F.nullif(F.sum(F.col("n") * F.col("known")), F.lit(0))).alias("level"),
                *(F.coalesce(F.bool_or(F.when(there, F.col(c))), F.lit(False)).alias(c) for c in ("soft", "engaged")), F.sum("good").alias("good"), F.sum("polar").alias("polar"),
            ]
            carried = ["moods", "level"]
        units = numbered.groupBy(KEY, "unit_id").agg(
            F.min("is_sender").alias("is_sender"), F.min("ts").alias("ts"), F.min("ts_sec").alias("start_sec"), F.max("ts").alias("end_ts"), F.max("ts_sec").alias("end_sec"),
            F.min_by("id", F.struct("ts", "id")).alias("first_id"), F.coalesce(F.bool_or("liked"), F.lit(False)).alias("liked"), *felt,
        )
        begins = timeline.begins_session("ts", "end_ts")
        linked = timeline.with_runs(timeline.with_day(units), "session_id", ["ts", "end_ts", "unit_id", "is_sender", "start_sec", "end_sec", "first_id", *carried], begins, [KEY], ["ts", "unit_id"])
        return staged(linked.withColumn("prev_session_id", F.col("session_id") - F.coalesce(begins, F.lit(True)).cast("long")).drop("day", "prev_end_ts"))

    @cached_property
    def sessions(self) -> DataFrame:
        """``conversation_id, session_id, initiator, liked``."""
        return self.units.groupBy(KEY, "session_id").agg(F.min_by("is_sender", F.struct("ts", "unit_id")).alias("initiator"), F.bool_or("liked").alias("liked"))

    def turns(self) -> DataFrame:
        """Neighbouring units of different sides: the later one, with the seconds between them."""
        return self.units.where("prev_is_sender <> is_sender").withColumn("gap_sec", F.col("start_sec") - F.col("prev_end_sec"))

    @cached_property
    def pairs(self) -> DataFrame:
        """:meth:`turns` with the ``likeness`` of both units' vectors, null where one has none; once for each pair of vectors where ids have several."""
        v = self.vectors.select("vec_id", "embedding")
        own, before = v.toDF("first_id", "_own"), v.toDF("prev_first_id", "_before")
        rows = self.turns().where(f"{KEY} is not null and unit_id is not null and prev_unit_id is not null").drop("end_ts", "end_sec", "prev_end_sec", "good", "polar", "liked")
        both = rows.join(own, "first_id", "left").join(before, "prev_first_id", "left")
        return staged(both.withColumn("likeness", cosine(F.col("_own"), F.col("_before"))).drop("_own", "_before", "first_id", "prev_first_id"))

    @cached_property
    def statistics(self) -> DataFrame:
        """Per conversation: messages, days with any, days from the first to the last, sessions and those that the other side began."""
        of_messages = self.messages.groupBy(KEY).agg(
            F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("chat_days"), ((F.max("ts_sec") - F.min("ts_sec")) / timeline.DAY).alias("span_days"),
            F.count_if(F.col("is_sender") == 0).alias("n_other"), F.count_if((F.col("is_sender") == 0) & (F.col("message_type") == STICKER)).alias("stickers_other"),
        )
        of_sessions = self.sessions.groupBy(KEY).agg(F.count("*").alias("sessions"), F.count_if(F.col("initiator") == 0).alias("sessions_other"))
        return staged(of_messages.join(of_sessions, KEY, "left").na.fill(0, ["sessions", "sessions_other"]))

    @cached_property
    def engagement(self) -> DataFrame:
        return staged(engagement(self.messages, self.words))
