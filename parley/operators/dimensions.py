"""Scores of a conversation: investment, signals of risk, the overall score. All take DataFrames; limits and weights are parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.lexicon import CHAT, OWN_NAME, RECALL, Words
from parley.operators import timeline
from parley.operators.engagement import cooling, engagement, recalls, texts_of
from parley.operators.exchanges import Exchanges


@dataclass(frozen=True)
class Investment:
    """Weights and full or zero points of the seven parts of investment."""

    daily: float = 0.10
    timely: float = 0.20
    continuity: float = 0.20
    initiation: float = 0.20
    symmetry: float = 0.10
    unanswered: float = 0.10
    bursts: float = 0.10
    daily_full: float = 10.0
    timely_seconds: int = 300
    pairs_full: float = 15.0
    continuity_full: float = 0.5
    initiation_full: float = 0.5
    unanswered_zero: float = 6.7
    burst_points: float = 20.0
    no_bursts: float = 60.0
    long_chars: int = 50
    long_share_full: float = 0.3
    long_points: float = 10.0
    symmetry_long_chars: int = 100
    sticker_full: float = 0.05
    neutral: float = 38.0
    sessions_full: float = 20.0
    days_full: float = 25.0
    power: float = 1.5


def _clamped(x: Column, most: float = 100.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(most), x))


def shrunk(score: Column, confidence: Column, neutral: float, power: float = 1.5) -> Column:
    """A score drawn towards ``neutral`` the less it can be relied on."""
    sure = F.pow(_clamped(confidence, 1.0), F.lit(power))
    return _clamped(score * sure + neutral * (1 - sure))


def statistics(messages: DataFrame) -> DataFrame:
    """Per conversation: messages, days with any, days from the first to the last, sessions and those that the other side began."""
    return Exchanges(messages).statistics


def reply_symmetry(messages: DataFrame, p: Investment = Investment()) -> DataFrame:  # noqa: B008
    """Per conversation ``balance`` (the other side's share of characters), the shares of long texts, ``symmetry`` without stickers' part."""
    side = lambda v, c: F.sum(F.when(F.col("is_sender") == v, c).otherwise(0))
    chars = F.length("content")
    long = (chars >= p.symmetry_long_chars).cast("int")
    share = lambda v: F.coalesce(side(v, long) / F.nullif(side(v, F.lit(1)), F.lit(0)), F.lit(0.0))
    rows = texts_of(messages).groupBy("conversation_id").agg(
        F.coalesce(side(0, chars) / F.nullif(F.sum(chars), F.lit(0)), F.lit(0.5)).alias("balance"), share(0).alias("long_other"), share(1).alias("long_self"),
        F.sum((chars > p.long_chars).cast("int")).alias("n_long"),
    )
    even = _clamped(100 - F.abs(F.col("balance") - 0.5) * 80)
    alike = 100 - F.least(F.lit(100.0), F.abs(F.col("long_other") - F.col("long_self")) * 250)
    return rows.withColumn("symmetry", even * 0.40 + alike * 0.35)


def _with_stickers(p: Investment) -> Column:
    """``symmetry`` of :func:`reply_symmetry` and the part of the other side's stickers."""
    stickers = F.least(F.lit(1.0), F.coalesce(F.col("stickers_other") / F.nullif(F.col("n_other"), F.lit(0)), F.lit(0.0)) / p.sticker_full) * 100
    return _clamped(F.coalesce("symmetry", F.lit(50 * 0.40 + 100 * 0.35)) + stickers * 0.25)


def symmetry(messages: DataFrame, p: Investment = Investment()) -> DataFrame:  # noqa: B008
    """``conversation_id, balance, long_other, long_self, symmetry`` of conversations that have texts."""
    rows = reply_symmetry(messages, p).join(statistics(messages), "conversation_id")
    return rows.select("conversation_id", "balance", "long_other", "long_self", _with_stickers(p).alias("symmetry"))


def pair_likeness(messages: DataFrame, vectors: DataFrame, shared: Exchanges | None = None) -> DataFrame:
    """Per conversation the mean cosine of pairs of units that both have a vector, taken by their first message's id."""
    shared = shared or Exchanges(messages, vectors)
    return shared.pairs.groupBy("conversation_id").agg(F.avg("likeness").alias("likeness"))


@dataclass(frozen=True)
class Preference:
    """Weights of how often a liked topic comes up and of how it is gone on with; the share of sessions that is full."""

    mention: float = 0.40
    continuity: float = 0.60
    full_share: float = 0.30


def preference(messages: DataFrame, vectors: DataFrame, keywords: tuple[str, ...], p: Preference = Preference(), shared: Exchanges | None = None) -> DataFrame:  # noqa: B008
    """Per conversation ``sessions, matched, mention, continuity, preference``: the share of sessions in which a keyword occurs (whatever its case), and the
    mean likeness of the pairs of units that begin in these. Without keywords all scores are null, and the dimension doesn't count.
    """
    words = any(k.strip() for k in keywords)
    shared = shared or Exchanges(messages, vectors, liked=keywords)
    total = shared.sessions.groupBy("conversation_id").agg(F.count("session_id").alias("sessions"))
    hits = shared.sessions.where("liked and conversation_id is not null").select("conversation_id", "session_id")
    matched = hits.groupBy("conversation_id").agg(F.count("*").alias("matched"))
    begun = shared.pairs.join(hits.withColumnRenamed("session_id", "prev_session_id"), ["conversation_id", "prev_session_id"])
    like = begun.groupBy("conversation_id").agg(F.avg("likeness").alias("likeness"))
    rows = total.join(matched, "conversation_id", "left").na.fill(0, ["matched"]).join(like, "conversation_id", "left")
    known = lambda c: F.when(F.lit(words), F.round(c + 1e-9, 2))
    mention = known(F.least(F.lit(100.0), F.col("matched") / F.col("sessions") / p.full_share * 100))
    continuity = known(_clamped(F.coalesce("likeness", F.lit(0.0)), 1.0) * 100)
    return rows.select("conversation_id", "sessions", "matched", mention.alias("mention"), continuity.alias("continuity"), known(mention * p.mention + continuity * p.continuity).alias("preference"))


def investment(messages: DataFrame, vectors: DataFrame, words: Words = CHAT, p: Investment = Investment(), shared: Exchanges | None = None) -> DataFrame:  # noqa: B008
    """One row per conversation: the seven parts, the bonus for long texts and ``investment``, drawn to the middle where there is little to go by."""
    shared = shared or Exchanges(messages, vectors, words=words)
    pairs = shared.turns().groupBy("conversation_id").agg(F.count("*").alias("pairs"), F.count_if((F.col("gap_sec") >= 0) & (F.col("gap_sec") <= p.timely_seconds)).alias("timely"))
    rows = shared.statistics.join(pairs, "conversation_id", "left").join(pair_likeness(messages, vectors, shared), "conversation_id", "left")
    rows = rows.join(reply_symmetry(messages, p), "conversation_id", "left").join(shared.engagement, "conversation_id", "left")
    rows = rows.na.fill(0, ["pairs", "timely", "n_texts", "n_long", "long_unanswered_other", "bursts_other", "bursts_self"])
    per_100 = lambda c: F.when(F.col("n_texts") > 0, F.col(c) * 100.0 / F.col("n_texts")).otherwise(0.0)
    theirs, mine = per_100("bursts_other"), per_100("bursts_self")
    parts = {
        "daily": F.when(F.col("span_days") > 0, F.least(F.lit(100.0), F.col("n") / F.greatest(F.col("span_days"), F.lit(1.0)) / p.daily_full * 100)).otherwise(0.0),
        "timely": F.when(F.col("pairs") > 0, F.col("timely") / F.col("pairs") * 100 * F.least(F.lit(1.0), F.col("pairs") / p.pairs_full)).otherwise(0.0),
        "continuity": F.least(F.lit(100.0), _clamped(F.coalesce("likeness", F.lit(0.0)), 1.0) / p.continuity_full * 100),
        "initiation": F.when(F.col("sessions") > 0, F.least(F.lit(100.0), F.col("sessions_other") / F.col("sessions") / p.initiation_full * 100)).otherwise(0.0),
        "symmetry": _with_stickers(p),
        "unanswered": 100 - F.least(F.lit(100.0), per_100("long_unanswered_other") / p.unanswered_zero * 100),
        "bursts": F.when((theirs <= 0) & (mine <= 0), p.no_bursts).otherwise(_clamped(50 + (theirs - mine) * p.burst_points)),
    }
    bonus = F.least(F.lit(p.long_points), F.col("n_long") / F.col("n") / p.long_share_full * p.long_points)
    scored = rows.select("conversation_id", "sessions", "chat_days", *(c.alias(f"p_{k}") for k, c in parts.items()), F.coalesce(bonus, F.lit(0.0)).alias("long_bonus"))
    total = F.least(F.lit(100.0), sum((F.col(f"p_{k}") * getattr(p, k) for k in parts), F.col("long_bonus")))
    confidence = F.least(F.lit(1.0), F.col("sessions") / p.sessions_full) * 0.55 + F.least(F.lit(1.0), F.col("chat_days") / p.days_full) * 0.45
    return scored.select("conversation_id", *(F.col(f"p_{k}").alias(k) for k in parts), "long_bonus", shrunk(total, confidence, p.neutral, p.power).alias("investment"))


@dataclass(frozen=True)
class Risk:
    """From where on each signal of risk is met."""

    variation: float = 0.8
    their_initiation: float = 0.35
    my_bursts: float = 3.0
    their_perfunctory: float = 0.15
    one_sided_least: int = 2
    recalls: float = 2.0
    decline: float = 0.5
    early_daily: float = 5.0


SIGNALS = ("hot_cold", "one_sided", "denial", "warm_then_cold")


def risk_signals(messages: DataFrame, evidence: DataFrame | None = None, words: Words = CHAT, pattern: str = RECALL, own: tuple[str, ...] = OWN_NAME, p: Risk = Risk()) -> DataFrame:  # noqa: B008
    """One row per conversation: four signals at ``normal``, ``watch`` (by the numbers or by evidence) or ``alert`` (by both), and the highest.

    ``evidence(conversation_id, hot_cold, one_sided, denial, warm_then_cold)`` says where quotes support a signal.
    """
    sessions = timeline.sessions(messages).groupBy("conversation_id").agg(F.count("*").alias("sessions"), F.count_if(F.col("initiator") == 0).alias("theirs_begun"))
    rows = messages.select("conversation_id").distinct().join(engagement(messages, words), "conversation_id", "left").join(sessions, "conversation_id", "left")
    rows = rows.join(recalls(messages, pattern, own), "conversation_id", "left").join(cooling(messages), "conversation_id", "left")
    if evidence is not None:
        rows = rows.join(evidence.select("conversation_id", *(F.col(s).cast("boolean").alias(f"said_{s}") for s in SIGNALS)), "conversation_id", "left")
    per_100 = lambda c: F.when(F.col("n_texts") > 0, c * 100.0 / F.col("n_texts")).otherwise(0.0)
    one = (F.coalesce(F.col("sessions") > 0, F.lit(False)) & (F.col("theirs_begun") / F.col("sessions") < p.their_initiation)).cast("int")
    one = one + (per_100(F.coalesce("bursts_self", F.lit(0))) >= p.my_bursts).cast("int") + (F.coalesce("perfunctory_other", F.lit(0.0)) >= p.their_perfunctory).cast("int")
    met = {
        "hot_cold": F.col("variation") >= p.variation,
        "one_sided": one >= p.one_sided_least,
        "denial": per_100(F.coalesce("mine", F.lit(0)) + F.coalesce("theirs", F.lit(0))) >= p.recalls,
        "warm_then_cold": (F.col("early") >= p.early_daily) & (F.col("recent") < F.col("early") * p.decline),
    }
    said = lambda s: F.coalesce(F.col(f"said_{s}"), F.lit(False)) if evidence is not None else F.lit(False)
    points = {s: F.coalesce(c, F.lit(False)).cast("int") + said(s).cast("int") for s, c in met.items()}
    named = lambda c: F.when(c == 2, "alert").when(c == 1, "watch").otherwise("normal")
    return rows.select("conversation_id", *(named(c).alias(s) for s, c in points.items()), named(F.greatest(*points.values())).alias("highest"))


#: Weights of the dimensions; those that are missing leave theirs to the others.
DIMENSIONS = {"investment": 0.40, "resonance": 0.35, "closeness": 0.15, "preference": 0.10, "relationship": 0.08}
#: Bands of the overall score, from the top.
BANDS = ((75.0, "very high"), (60.0, "high"), (45.0, "medium"), (35.0, "moderate"), (25.0, "low"))


def overall(scores: DataFrame, stats: DataFrame, weights: dict[str, float] | None = None, neutral: float = 35.0) -> DataFrame:
    """``conversation_id, overall, band`` from dimensions that ``scores`` has (nulls count as missing) and :func:`statistics`."""
    weights = {k: w for k, w in (weights or DIMENSIONS).items() if k in scores.columns}
    rows = scores.join(stats, "conversation_id")
    total = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    full = lambda c, most: F.least(F.lit(1.0), F.col(c) / float(most))
    confidence = full("sessions", 30) * 0.35 + full("chat_days", 30) * 0.35 + full("n", 400) * 0.20 + full("sessions_other", 12) * 0.10
    score = F.round(shrunk(F.when(weight > 0, total / weight).otherwise(0.0), confidence, neutral) + 1e-9, 2)
    named = F.lit("very low")
    for least, name in reversed(BANDS):
        named = F.when(F.col("overall") >= least, name).otherwise(named)
    return rows.select("conversation_id", score.alias("overall")).withColumn("band", named)
