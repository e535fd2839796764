"""Resonance of a conversation: how moods are answered, in pairs of neighbouring units of both sides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.lexicon import CHAT, Words
from parley.functions.numbers import rounded
from parley.operators.dimensions import shrunk
from parley.operators.exchanges import Exchanges

# Words of replies that are softly positive, and of those that take part.
SOFT = ("哈哈", "嘿嘿", "嗯", "嗯嗯", "好呀", "好啊", "好哦", "好呢", "可以", "行呀", "行啊", "收到", "好的", "没问题", "真好", "太好了", "好耶", "ok", "okay")


@dataclass(frozen=True)
class Resonance:
    """Weights of the five parts, and the points at which they are full, empty or sure."""

    reciprocity: float = 0.35
    consistency: float = 0.20
    matching: float = 0.10
    valence: float = 0.20
    attention: float = 0.15
    window: int = 3_600
    fast: int = 300
    like: float = 0.45
    soft: float = 0.20
    prior: float = 0.50
    prior_pairs: float = 4.0
    plain_from: float = 0.95
    reciprocity_pairs: float = 15.0
    pairs: float = 20.0
    valence_full: float = 5.0 / 6.0
    perfunctory_zero: float = 0.30
    depth_pairs: float = 25.0
    depth_positive: float = 15.0
    depth_days: float = 14.0
    depth_span: float = 30.0
    neutral: float = 40.0
    cut: float = 0.3


RESONANCE = Resonance()


def mood_pairs(messages: DataFrame, moods: DataFrame, vectors: DataFrame, soft: tuple[str, ...] = SOFT, engaged: tuple[str, ...] = (), p: Resonance = RESONANCE, shared: Exchanges | None = None) -> DataFrame:
    """Pairs ``conversation_id, prev_unit_id, unit_id, gap_sec, likeness`` with each side's mean intensity (``prev_level, level``), polarity, and whether the
    reply holds soft or engaged words. ``moods`` are ``message_id, intensity``; ``vectors`` are ``vec_id, embedding``, taken by a unit's first message.
    """
    shared = shared or Exchanges(messages, vectors, moods, soft, engaged, cut=p.cut)
    polarity = lambda c: F.when(F.col(c) > p.cut, 1).when(F.col(c) < -p.cut, -1).otherwise(0)
    rated = shared.pairs.where("moods > 0 and prev_moods > 0")
    return rated.withColumns({"polarity": polarity("level"), "prev_polarity": polarity("prev_level")}).drop("moods", "prev_moods", "is_sender", "prev_is_sender", "session_id", "prev_session_id")


def positive_response(p: Resonance = RESONANCE) -> Column:
    """0 to 1 for a pair's reply to something positive: a positive one counts most, a soft, like, engaged or fast one in part, a negative one nothing."""
    fast = F.when(F.col("gap_sec") <= p.fast, 0.08).otherwise(0.0)
    like = F.coalesce(F.col("likeness") >= p.like, F.lit(False))
    strong = F.least(F.lit(1.0), 0.86 + F.least(F.lit(0.10), F.greatest(F.lit(0.0), F.col("level")) * 0.12) + F.when(like, 0.08).otherwise(0.0) + fast)
    warm = F.col("level") >= p.soft
    parts = ((warm | F.col("soft"), 0.25), (like, 0.14), (warm, 0.12), (F.col("engaged"), 0.14))
    mild = F.least(F.lit(0.85), sum((F.when(c, x).otherwise(0.0) for c, x in parts), fast))
    return F.when(F.col("polarity") < 0, 0.0).when(F.col("polarity") == 1, strong).otherwise(mild)


def resonance(messages: DataFrame, moods: DataFrame, vectors: DataFrame, soft: tuple[str, ...] = SOFT, engaged: tuple[str, ...] = (), words: Words = CHAT, p: Resonance = RESONANCE, shared: Exchanges | None = None) -> DataFrame:
    """``conversation_id, reciprocity, consistency, matching, valence, attention, resonance`` of conversations that have pairs.

    Reciprocity is the mean answer to positive units within an hour, with a prior; consistency the share of pairs of one polarity and their likeness;
    matching how close intensities are; valence the share of positive messages among those with a polarity; attention how seldom the other side's replies are
    perfunctory. Parts and the whole are drawn to the middle the fewer pairs and days they rest on.
    """
    shared = shared or Exchanges(messages, vectors, moods, soft, engaged, words=words, cut=p.cut)
    full = lambda c, most: F.least(F.lit(1.0), c / most)
    two = lambda c: rounded(c, 2)
    kind = (F.col("prev_polarity") == 1) & (F.col("gap_sec") <= p.window)
    same = F.col("prev_polarity") == F.col("polarity")
    day = F.to_date
    found = mood_pairs(messages, moods, vectors, soft, engaged, p, shared).withColumn("answer", positive_response(p)).groupBy("conversation_id").agg(
        F.count("*").alias("n"), F.count_if(kind).alias("n_kind"), F.avg(F.when(kind, F.col("answer"))).alias("raw"), F.count_if(same).alias("n_same"),
        F.avg(F.when(same, F.coalesce("likeness", F.lit(0.0)))).alias("alike"), F.avg(F.abs(F.col("prev_level") - F.col("level"))).alias("apart"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.array(day("ts"), day("prev_ts")))))).alias("days"), F.min(F.least("start_sec", "prev_start_sec")).alias("first"), F.max(F.greatest("start_sec", "prev_start_sec")).alias("last"),
    )
    sure = full(F.col("n_kind"), p.prior_pairs)
    smoothed = F.when(F.col("raw") >= p.plain_from, F.col("raw")).otherwise(F.col("raw") * sure + p.prior * (1 - sure)) * 100
    reciprocity = F.when(F.col("n_kind") > 0, two(shrunk(smoothed, F.col("n_kind") / p.reciprocity_pairs, p.neutral))).otherwise(0.0)
    consistency = F.when(F.col("n_same") > 0, two(shrunk((F.col("n_same") / F.col("n") * 0.7 + F.col("alike") * 0.3) * 100, F.col("n") / p.pairs, p.neutral))).otherwise(0.0)
    matching = two(shrunk(F.tanh(1 / (F.col("apart") + 0.1)) * 100, F.col("n") / p.pairs, p.neutral))
    polar = shared.units.groupBy("conversation_id").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("polar"), F.lit(0)).alias("polar"))
    dull = shared.engagement.select("conversation_id", "perfunctory_other")
    rows = found.join(polar, "conversation_id", "left").join(dull, "conversation_id", "left")
    valence = F.when(F.col("polar") > 0, two(full(F.col("good") / F.col("polar"), p.valence_full) * 100)).otherwise(50.0)
    attention = two(100 - full(F.coalesce("perfunctory_other", F.lit(0.0)), p.perfunctory_zero) * 100)
    span = F.greatest(F.lit(1), F.expr("(last - first) div 86400 + 1"))
    depth = full(F.col("n"), p.depth_pairs) * 0.4 + full(F.col("n_kind"), p.depth_positive) * 0.3 + full(F.col("days"), p.depth_days) * 0.2 + full(span, p.depth_span) * 0.1
    parts = {"reciprocity": reciprocity, "consistency": consistency, "matching": matching, "valence": valence, "attention": attention}
    scored = rows.select("conversation_id", *(c.alias(k) for k, c in parts.items()), F.round(depth, 4).alias("depth"))
    base = sum((F.col(k) * getattr(p, k) for k in parts), F.lit(0.0))
    return scored.select("conversation_id", *parts, two(shrunk(base, F.col("depth"), p.neutral)).alias("resonance"))
