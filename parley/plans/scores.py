"""Scores: anchors, weighted composites, shrinkage, tests of balance, and array arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.numbers import cosine, interpolated, rounded, weighted
from parley.functions.tolerant import tolerant_json
from parley.operators import dimensions, timeline, words
from parley.operators import resonance as resonances
from parley.operators.balance import initiative_bands, two_sided_binomial
from parley.operators.exchanges import Exchanges
from parley.plans.ctes import ENGAGED, OWN, PAIRS, RECALL, SESSIONS, UNITS, WORDS
from parley.registry import declare, operator
from parley.views import MS, S, M, messages, sentiment, table, with_views

#: Anchors (value, score) of a few indicators, and the weights of traits: parameters of the composites below.
ANCHORS = {"short_share": ((0.0, 90.0), (0.3, 60.0), (0.7, 30.0), (1.0, 10.0)), "late_share": ((0.0, 20.0), (0.1, 50.0), (0.3, 80.0)), "my_share": ((0.2, 20.0), (0.5, 70.0), (0.8, 40.0))}
WEIGHTS = {"short_share": 0.4, "late_share": 0.35, "my_share": 0.25}
NEUTRAL = 50.0


def _anchored_sql(x: str, anchors: tuple) -> str:
    parts = [f"when {x} <= {anchors[0][0]} then {anchors[0][1]}"]
    for (x0, y0), (x1, y1) in zip(anchors[:-1], anchors[1:], strict=True):
        parts.append(f"when {x} <= {x1} then {y0} + ({x} - {x0}) * {(y1 - y0) / (x1 - x0)}")
    return f"(case when {x} is null then null {' '.join(parts)} else {anchors[-1][1]} end)"


_INDICATORS = """i as (select member, count(*) as n, avg(case when length(content) <= 14 then 1e0 else 0e0 end) as short_share, case when count(*) >= 60 then avg(case when hour(ts) < 5 then 1e0 else 0e0 end) end as late_share,
  avg(cast(is_sender as double)) as my_share from m group by member)"""


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return messages(spark, sf_dir).groupBy("member").agg(
        F.count("*").alias("n"), share(F.length("content") <= 14).alias("short_share"), F.when(F.count("*") >= 60, share(F.hour("ts") < 5)).alias("late_share"), F.avg(F.col("is_sender").cast("double")).alias("my_share")
    )


_SCORED = ", ".join(f"{_anchored_sql(k, a)} as s_{k}" for k, a in ANCHORS.items())


@operator("mth_01", f"with {M}, {_INDICATORS}, s as (select member, {_SCORED} from i) select member, " + ", ".join(f"round(s_{k} + 1e-9, 4) as {k}" for k in ANCHORS) + " from s")
def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators on a scale of 0 to 100 by piecewise linear anchors."""
    return indicators(spark, sf_dir).select("member", *(rounded(interpolated(F.col(k), a)).alias(k) for k, a in ANCHORS.items()))


_COMPOSITE = f"({' + '.join(f'coalesce(s_{k} * {w}, 0)' for k, w in WEIGHTS.items())}) / ({' + '.join(f'case when s_{k} is null then 0e0 else {w} end' for k, w in WEIGHTS.items())})"


def composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = indicators(spark, sf_dir).select("member", "n", *(interpolated(F.col(k), a).alias(k) for k, a in ANCHORS.items()))
    return scored.withColumn("composite", weighted(WEIGHTS))


@operator("mth_02", f"with {M}, {_INDICATORS}, s as (select member, n, {_SCORED} from i) select member, round({_COMPOSITE} + 1e-9, 4) as composite from s")
def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted composite over the indicators that are present."""
    return composites(spark, sf_dir).select("member", rounded(F.col("composite")).alias("composite"))


@operator("mth_03", f"""with {M}, {_INDICATORS}, z as (select member, (my_share - avg(my_share) over ()) / stddev_pop(my_share) over () as a, (short_share - avg(short_share) over ()) / nullif(stddev_pop(short_share) over (), 0) as b from i)
select member, round(greatest(0, least(100, 50 + 15 * a + greatest(-10, least(10, 5 * coalesce(b, 0))))) + 1e-9, 3) as score from z""")
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels in standard units, mapped to 0 to 100, the second within ten points. Means come from an aggregate, not a window over all rows."""
    i = indicators(spark, sf_dir)
    m = i.agg(F.avg("my_share").alias("ma"), F.stddev_pop("my_share").alias("sa"), F.avg("short_share").alias("mb"), F.stddev_pop("short_share").alias("sb"))
    a, b = (F.col("my_share") - F.col("ma")) / F.col("sa"), F.col("short_share") - F.col("mb")
    second = F.coalesce(F.when(F.col("sb") > 0, b / F.col("sb")), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 15 * a + F.greatest(F.lit(-10.0), F.least(F.lit(10.0), 5 * second))))
    return i.join(F.broadcast(m)).select("member", rounded(score, 3).alias("score"))


@operator("mth_04", f"""with {M}, i as (select member, count(*) as n, cast(sum(is_sender) as bigint) as mine from m group by 1)
select member, n, mine, round(case when 2 * mine = n then 1e0 else least(1e0, 2 * list_sum(list_transform(range(0, least(mine, n - mine) + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) - n * ln(2e0))))) end, 6) as p_value from i""")
def balance_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided exact binomial probability that a member's side shares are even."""
    i = messages(spark, sf_dir).groupBy("member").agg(F.count("*").alias("n"), F.sum("is_sender").cast("long").alias("mine"))
    return two_sided_binomial(i, "mine", "n").select("member", "n", "mine", F.round("p_value", 6).alias("p_value"))


_BINOMIAL = "case when 2 * mine = n then 1e0 else least(1e0, 2 * list_sum(list_transform(range(0, least(mine, n - mine) + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) - n * ln(2e0))))) end"


@operator("mth_05", f"""with {MS}, {UNITS.replace(" from m ", " from ms ")}, {SESSIONS}, i as (select conversation_id, count(*) as n, count(*) filter (where initiator = 0) as mine from sess group by 1), h as (select *, {_BINOMIAL} as p, 2 * asin(sqrt(mine * 1e0 / n)) - 2 * asin(sqrt(0.5e0)) as h from i)
select conversation_id, n, round(h + 1e-9, 4) as effect, case when n < 5 then 'insufficient' when p >= 0.05 or abs(h) < 0.2 then 'balanced' when h >= 0.5 then 'other dominant' when h > 0 then 'other leans' when h <= -0.5 then 'self dominant' else 'self leans' end as band from h""")
def balance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who begins sessions: Cohen's h against one half, in bands, where the share differs from it significantly."""
    return initiative_bands(timeline.sessions(messages(spark, sf_dir, sparse=True))).select("conversation_id", "n", rounded(F.col("effect")).alias("effect"), "band")


_CONFIDENCE = "(0.35 * least(1e0, n / 30e0) + 0.35 * least(1e0, active_days / 30e0) + 0.2 * least(1e0, chars / 400e0) + 0.1 * least(1e0, weeks / 12e0))"
_BASE = "b as (select member, count(*) as n, count(distinct cast(ts as date)) as active_days, cast(sum(length(content)) as bigint) as chars, count(distinct date_trunc('week', ts)) as weeks, avg(case when length(content) > 14 then 100e0 else 0e0 end) as raw from {m} group by member)"
declare("mth_06", "Scores drawn towards the middle by confidence to the power of 1.5.", f"""
with {_BASE}, k as (select *, {_CONFIDENCE} as confidence from b)
select member, round(raw * pow(confidence, 1.5) + {NEUTRAL} * (1 - pow(confidence, 1.5)) + 1e-9, 4) as shrunk from k""")
declare("mth_07", "Confidence by four capped ratios.", f"with {_BASE} select member, round({_CONFIDENCE} + 1e-9, 4) as confidence from b")
declare("mth_08", "Logistic calibration around 55.", f"with {_BASE} select member, round(100 / (1 + exp(-0.07e0 * (raw - 55))) + 1e-9, 4) as calibrated from b")

_FIVE = (0.40, 0.35, 0.15, 0.10, 0.08)
declare("mth_09", "Weights of five dimensions, normalised over those that are present.", f"""
with {_BASE}, p as (select member, {_FIVE[0]}e0 as w1, {_FIVE[1]}e0 as w2, case when n >= 50 then {_FIVE[2]}e0 else 0e0 end as w3, case when active_days >= 20 then {_FIVE[3]}e0 else 0e0 end as w4, case when weeks >= 5 then {_FIVE[4]}e0 else 0e0 end as w5 from b)
select member, """ + ", ".join(f"round(w{i} / (w1 + w2 + w3 + w4 + w5) + 1e-9, 4) as w{i}" for i in range(1, 6)) + " from p")

_STATISTICS = f"""{UNITS}, {SESSIONS}, st as (select conversation_id, count(*) as n, count(distinct cast(ts as date)) as chat_days, (max(ts_sec) - min(ts_sec)) / 86400e0 as span_days,
  count(*) filter (where is_sender = 0) as n_other, count(*) filter (where is_sender = 0 and message_type = 47) as stickers from m group by 1),
se as (select conversation_id, count(*) as sessions, count(*) filter (where initiator = 0) as sessions_other from sess group by 1)"""
_INVESTMENT = f"""{_STATISTICS}, {ENGAGED}, {PAIRS}, pc as (select conversation_id, count(*) as pairs, count(*) filter (where gap_sec between 0 and 300) as timely from pairs group by 1),
pl as (select p.conversation_id, avg(list_cosine_similarity(list_transform(x.embedding, lambda v: cast(v as double)), list_transform(y.embedding, lambda v: cast(v as double)))) as likeness from pairs p
  join u f on f.conversation_id = p.conversation_id and f.unit_id = p.from_unit join u t on t.conversation_id = p.conversation_id and t.unit_id = p.to_unit
  join embeddings x on x.vec_id = f.message_ids[1] join embeddings y on y.vec_id = t.message_ids[1] group by 1),
sy as (select conversation_id, coalesce(sum(length(c)) filter (where is_sender = 0), 0) * 1e0 / sum(length(c)) as balance, coalesce(avg((length(c) >= 100)::int) filter (where is_sender = 0), 0) as lo,
  coalesce(avg((length(c) >= 100)::int) filter (where is_sender = 1), 0) as ls, count(*) filter (where length(c) > 50) as n_long from tx group by 1),
ip as (select st.conversation_id, sessions, chat_days, case when span_days > 0 then least(100, n / greatest(span_days, 1) / 10 * 100) else 0 end as daily,
  coalesce(timely * 100e0 / pairs * least(1, pairs / 15e0), 0) as timely, least(100, greatest(0, least(1, coalesce(likeness, 0))) / 0.5 * 100) as continuity, least(100, sessions_other * 1e0 / sessions / 0.5 * 100) as initiation,
  0.40 * (100 - abs(balance - 0.5) * 80) + 0.35 * (100 - least(100, abs(lo - ls) * 250)) + 0.25 * 100 * least(1, coalesce(stickers * 1e0 / nullif(n_other, 0), 0) / 0.05) as symmetry,
  100 - least(100, long_unanswered_other * 100e0 / n_texts / 6.7 * 100) as unanswered,
  case when bursts_other = 0 and bursts_self = 0 then 60 else greatest(0, least(100, 50 + (bursts_other - bursts_self) * 100e0 / n_texts * 20)) end as bursts, least(10, n_long * 1e0 / n / 0.3 * 10) as long_bonus
  from st join se using (conversation_id) join pc using (conversation_id) left join pl using (conversation_id) join sy using (conversation_id) join eng using (conversation_id)),
iv as (select *, pow(least(1, 0.55 * least(1, sessions / 20e0) + 0.45 * least(1, chat_days / 25e0)), 1.5) as sure,
  least(100, 0.1 * daily + 0.2 * timely + 0.2 * continuity + 0.2 * initiation + 0.1 * symmetry + 0.1 * unanswered + 0.1 * bursts + long_bonus) as total from ip)"""
_PARTS = ("daily", "timely", "continuity", "initiation", "symmetry", "unanswered", "bursts", "long_bonus")


def _investment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.investment(messages(spark, sf_dir), table(spark, sf_dir, "embeddings"), WORDS)


@operator("mth_10", f"with {M}, {_INVESTMENT} select conversation_id, " + ", ".join(f"round({c} + 1e-9, 3) as {c}" for c in _PARTS) + ", round(total * sure + 38 * (1 - sure) + 1e-9, 3) as investment from iv")
def investment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investment: seven parts and a bonus for long texts, drawn to the middle where there is little to go by."""
    return _investment(spark, sf_dir).select("conversation_id", *(rounded(F.col(c), 3).alias(c) for c in (*_PARTS, "investment")))


@operator("mth_11", f"with {M}, {_INVESTMENT} select sy.conversation_id, round(balance + 1e-9, 4) as balance, round(lo + 1e-9, 4) as long_other, round(ls + 1e-9, 4) as long_self, round(symmetry + 1e-9, 4) as symmetry from sy join ip using (conversation_id)")
def symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetry of replies: both sides' characters, their shares of long texts, and the other side's stickers."""
    return dimensions.symmetry(messages(spark, sf_dir)).select("conversation_id", *(rounded(F.col(c)).alias(c) for c in ("balance", "long_other", "long_self", "symmetry")))


#: Words of events that stand for softly positive and for engaged replies.
SOFT_WORDS, ENGAGED_WORDS = (": 7",), ("view",)
_CAST_VECTOR = "list_transform(e.embedding, lambda x: cast(x as double))"
_RATED = f"""ul as (select u.conversation_id, u.unit_id, any_value(u.ts) as ts, any_value(u.start_sec) as start_sec, any_value(u.message_ids[1]) as vec_id, avg(s.intensity) as level, bool_or(contains(content, ': 7')) as soft, bool_or(contains(content, 'view')) as engaged
  from u, unnest(message_ids) as x(id) join s on s.message_id = x.id join m on m.id = x.id group by 1, 2),
up as (select ul.*, case when level > 0.3 then 1 when level < -0.3 then -1 else 0 end as polarity, {_CAST_VECTOR} as v from ul left join embeddings e using (vec_id)),
rp as (select p.conversation_id, p.from_unit, p.to_unit, p.gap_sec, f.level as la, t.level as lb, f.polarity as pa, t.polarity as pb, f.ts as ta, t.ts as tb, f.start_sec as sa, t.start_sec as sb, list_cosine_similarity(f.v, t.v) as alike, t.soft, t.engaged
  from pairs p join up f on f.conversation_id = p.conversation_id and f.unit_id = p.from_unit join up t on t.conversation_id = p.conversation_id and t.unit_id = p.to_unit),
ra as (select *, coalesce(alike >= 0.45, false)::int as near, (gap_sec <= 300)::int * 0.08e0 as quick, (lb >= 0.2)::int as warm from rp),
rs as (select *, case when pb < 0 then 0 when pb = 1 then least(1e0, 0.86e0 + least(0.1e0, greatest(0, lb) * 0.12e0) + near * 0.08e0 + quick) else least(0.85e0, quick + 0.25e0 * (warm = 1 or soft)::int + 0.14e0 * near + 0.12e0 * warm + 0.14e0 * engaged::int) end as answer from ra)"""


@operator("mth_13", f"with {M}, {S}, {UNITS}, {PAIRS}, {_RATED} select conversation_id, to_unit, round(answer + 1e-9, 4) as response from rs")
def pair_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each pair's reply to something positive."""
    pairs = resonances.mood_pairs(messages(spark, sf_dir), sentiment(spark, sf_dir), table(spark, sf_dir, "embeddings"), SOFT_WORDS, ENGAGED_WORDS)
    return pairs.select("conversation_id", F.col("unit_id").alias("to_unit"), rounded(resonances.positive_response()).alias("response"))


def _drawn(score: str, sure: str) -> str:
    return f"round(greatest(0, least(100, ({score}) * pow(greatest(0, least(1, {sure})), 1.5) + 40 * (1 - pow(greatest(0, least(1, {sure})), 1.5)))) + 1e-9, 2)"


_RESONANCE = f"""rg as (select conversation_id, count(*) as n, count(*) filter (where pa = 1 and gap_sec <= 3600) as k, avg(answer) filter (where pa = 1 and gap_sec <= 3600) as raw, count(*) filter (where pa = pb) as same, avg(coalesce(alike, 0)) filter (where pa = pb) as alike,
  avg(abs(la - lb)) as apart, min(least(sa, sb)) as first, max(greatest(sa, sb)) as last from rs group by 1),
rd as (select conversation_id, count(distinct d) as paired_days from (select conversation_id, cast(ta as date) as d from rs union select conversation_id, cast(tb as date) from rs) group by 1),
rm as (select conversation_id, count(*) filter (where intensity > 0.3) as good, count(*) filter (where abs(intensity) > 0.3) as polar from m join s on s.message_id = m.id group by 1),
rt as (select conversation_id, case when k > 0 then {_drawn("100 * case when raw >= 0.95 then raw else raw * least(1, k / 4e0) + 0.5 * (1 - least(1, k / 4e0)) end", "k / 15e0")} else 0 end as reciprocity,
  case when same > 0 then {_drawn("(same * 0.7e0 / n + alike * 0.3e0) * 100", "n / 20e0")} else 0 end as consistency, {_drawn("tanh(1 / (apart + 0.1e0)) * 100", "n / 20e0")} as matching,
  case when polar > 0 then round(least(1, (good * 1e0 / polar) / (5e0 / 6)) * 100 + 1e-9, 2) else 50 end as valence, round(100 - least(1, coalesce(perfunctory_other, 0) / 0.3e0) * 100 + 1e-9, 2) as attention,
  round(least(1, n / 25e0) * 0.4 + least(1, k / 15e0) * 0.3 + least(1, paired_days / 14e0) * 0.2 + least(1, greatest(1, (last - first) // 86400 + 1) / 30e0) * 0.1, 4) as depth
  from rg join rd using (conversation_id) left join rm using (conversation_id) left join eng using (conversation_id)),
ro as (select *, {_drawn("0.35 * reciprocity + 0.2 * consistency + 0.1 * matching + 0.2 * valence + 0.15 * attention", "depth")} as resonance from rt)"""
_RESONANCE_PARTS = ("reciprocity", "consistency", "matching", "valence", "attention", "resonance")


def _resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resonances.resonance(messages(spark, sf_dir), sentiment(spark, sf_dir), table(spark, sf_dir, "embeddings"), SOFT_WORDS, ENGAGED_WORDS, WORDS)


@operator("mth_12", f"with {M}, {S}, {UNITS}, {PAIRS}, {ENGAGED}, {_RATED}, {_RESONANCE} select conversation_id, {', '.join(_RESONANCE_PARTS)} from ro")
def resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resonance: reciprocity with a prior, polarity, intensity, balance and attention, drawn to the middle where there is little to go by."""
    return _resonance(spark, sf_dir)


@operator("mth_14", f"""with {M}, {S}, n as (select m.conversation_id, m.id, m.ts, m.content, row_number() over (partition by m.conversation_id order by m.ts, m.id) as k, s.intensity from m join s on s.message_id = m.id where s.polarity = -1),
l as (select *, id - lag(id) over w as step, lag(left(content, 5)) over w as before from n window w as (partition by conversation_id order by k)),
e as (select *, sum(case when step <= 40 and before = left(content, 5) then 0 else 1 end) over (partition by conversation_id order by k) as episode from l),
d as (select *, row_number() over (partition by conversation_id, episode order by k) - 1 as depth from e), w as (select conversation_id, id, depth, abs(intensity) * greatest(0.35, pow(0.55, depth)) as weight from d)
select conversation_id, id, depth, round(weight + 1e-9, 4) as weight from w where weight >= 0.15""")
def opportunity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of negative messages, falling with their place in an episode of neighbours that share a cue."""
    n = timeline.with_day(messages(spark, sf_dir).join(sentiment(spark, sf_dir).where("polarity = -1"), F.col("id") == F.col("message_id"))).withColumn("cue", F.substring("content", 1, 5))
    starts = (F.col("id") - F.col("prev_id") > 40) | (F.col("prev_cue") != F.col("cue"))
    runs = timeline.with_runs(n, "episode", ["id", "cue"], starts, ["conversation_id"], ["ts", "id"])
    depth = F.row_number().over(Window.partitionBy("conversation_id", "episode").orderBy("ts", "id")) - 1
    weight = F.abs("intensity") * F.greatest(F.lit(0.35), F.pow(F.lit(0.55), "depth"))
    return runs.withColumn("depth", depth).withColumn("weight", weight).where("weight >= 0.15").select("conversation_id", "id", "depth", rounded(F.col("weight")).alias("weight"))


declare("mth_15", "Closeness: parts from nights, shares, questions and marks, with a capped bonus.", """
with b as (select conversation_id, avg(case when hour(ts) >= 23 or hour(ts) < 5 then 1e0 else 0e0 end) as night, avg(case when message_type in (3, 43) then 1e0 else 0e0 end) as shares, avg(case when message_type = 47 then 1e0 else 0e0 end) as stickers,
  avg(case when content like '%: 7%' then 1e0 else 0e0 end) as marks, avg(length(content)) as chars, count(distinct cast(ts as date)) as days from {ms} group by 1)
select conversation_id, round(0.2 * least(100e0, night * 300) + 0.2 * least(100e0, shares * 300) + 0.15 * least(100e0, stickers * 300) + 0.15 * least(100e0, marks * 500) + 0.15 * least(100e0, chars * 5) + 0.15 * least(100e0, days * 4e0)
  + least(8e0, days * 0.2e0) + 1e-9, 4) as closeness from b""")


#: What a member likes, in the words that events are made of.
LIKED = (": 77", ": 9}")
_PREFERENCE = f"""pm as (select distinct sr.conversation_id, sr.sid from sr, unnest(message_ids) as x(id) join m on m.id = x.id where contains(content, ': 77') or contains(content, ': 9}}')),
pq as (select p.conversation_id, avg(list_cosine_similarity(list_transform(x.embedding, lambda v: cast(v as double)), list_transform(y.embedding, lambda v: cast(v as double)))) as likeness from pairs p
  join sr f on f.conversation_id = p.conversation_id and f.unit_id = p.from_unit join pm on pm.conversation_id = f.conversation_id and pm.sid = f.sid join u t on t.conversation_id = p.conversation_id and t.unit_id = p.to_unit
  join embeddings x on x.vec_id = f.message_ids[1] join embeddings y on y.vec_id = t.message_ids[1] group by 1),
pn as (select conversation_id, count(distinct sid) as sessions from sr group by 1), pk as (select conversation_id, count(*) as matched from pm group by 1),
pf as (select conversation_id, sessions, coalesce(matched, 0) as matched, round(least(100, coalesce(matched, 0) * 1e0 / sessions / 0.3e0 * 100) + 1e-9, 2) as mention, round(greatest(0, least(1, coalesce(likeness, 0))) * 100 + 1e-9, 2) as continuity
  from pn left join pk using (conversation_id) left join pq using (conversation_id)),
pr as (select *, round(0.4 * mention + 0.6 * continuity + 1e-9, 2) as preference from pf)"""


def _preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.preference(messages(spark, sf_dir), table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), LIKED)


@operator("mth_16", f"with {M}, {UNITS}, {PAIRS}, {SESSIONS}, {_PREFERENCE} select conversation_id, sessions, matched, mention, continuity, preference from pr")
def preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a liked topic comes up in sessions (30 % is full), and how alike the exchanges in these are."""
    return _preference(spark, sf_dir)


_WHOLE = f"""{_INVESTMENT}, {_RATED}, {_RESONANCE}, re as (select conversation_id, resonance from ro), {_PREFERENCE},
ov as (select iv.conversation_id, (0.4 * (total * sure + 38 * (1 - sure)) + 0.35 * coalesce(resonance, 0) + 0.1 * coalesce(preference, 0)) / (0.4 + case when resonance is null then 0 else 0.35 end + case when preference is null then 0 else 0.1 end) as score,
  pow(0.35 * least(1, iv.sessions / 30e0) + 0.35 * least(1, iv.chat_days / 30e0) + 0.2 * least(1, st.n / 400e0) + 0.1 * least(1, se.sessions_other / 12e0), 1.5) as steady
  from iv join st using (conversation_id) join se using (conversation_id) left join re using (conversation_id) left join pr using (conversation_id)),
oc as (select conversation_id, round(score * steady + 35 * (1 - steady) + 1e-9, 2) as overall from ov)"""


@operator("mth_17", f"""with {M}, {S}, {_WHOLE} select conversation_id, overall, case when overall >= 75 then 'very high' when overall >= 60 then 'high' when overall >= 45 then 'medium'
  when overall >= 35 then 'moderate' when overall >= 25 then 'low' else 'very low' end as band from oc""")
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overall score of the dimensions that are there, and its band."""
    m, moods, vectors = messages(spark, sf_dir), sentiment(spark, sf_dir), table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    shared = Exchanges(m, vectors, moods, SOFT_WORDS, ENGAGED_WORDS, LIKED, WORDS, resonances.RESONANCE.cut)
    scores = dimensions.investment(m, vectors, WORDS, shared=shared).select("conversation_id", "investment")
    scores = scores.join(resonances.resonance(m, moods, vectors, SOFT_WORDS, ENGAGED_WORDS, WORDS, shared=shared).select("conversation_id", "resonance"), "conversation_id", "left")
    scores = scores.join(dimensions.preference(m, vectors, LIKED, shared=shared).select("conversation_id", "preference"), "conversation_id", "left")
    return dimensions.overall(scores, shared.statistics)


_LEVEL = "case when {0} = 2 then 'alert' when {0} = 1 then 'watch' else 'normal' end"


@operator("mth_18", f"""with {M}, {_STATISTICS}, {ENGAGED}, rc as (select conversation_id, count(*) as recalls from m where message_type = 10000 and regexp_matches(content, '{RECALL}') group by 1),
wc as (select conversation_id, avg(n) filter (where k <= days // 3) as early, avg(n) filter (where k > days - days // 3) as recent from (select *, row_number() over (partition by conversation_id order by day) as k, count(*) over (partition by conversation_id) as days from td) where days >= 6 group by 1),
rs as (select conversation_id, (coalesce(variation >= 0.8, false))::int + (conversation_id % 2 = 0)::int as hot_cold,
  ((coalesce(sessions_other * 1e0 / nullif(sessions, 0) < 0.35, false)::int + (coalesce(bursts_self, 0) * 100e0 / n_texts >= 3)::int + (coalesce(perfunctory_other, 0) >= 0.15)::int) >= 2)::int as one_sided,
  (coalesce(recalls, 0) * 100e0 / n_texts >= 2)::int + (conversation_id % 3 = 0)::int as denial, coalesce(early >= 5 and recent < early * 0.5, false)::int as warm_then_cold
  from eng left join se using (conversation_id) left join rc using (conversation_id) left join wc using (conversation_id))
select conversation_id, {", ".join(f"{_LEVEL.format(x)} as {x}" for x in dimensions.SIGNALS)}, {_LEVEL.format("greatest(hot_cold, one_sided, denial, warm_then_cold)")} as highest from rs""")
def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four signals of risk by the numbers and by (stand-in) evidence, and the highest level."""
    m = messages(spark, sf_dir)
    said = lambda n: F.col("conversation_id") % n == 0
    evidence = m.select("conversation_id").distinct().select("conversation_id", said(2).alias("hot_cold"), F.lit(False).alias("one_sided"), said(3).alias("denial"), F.lit(None).alias("warm_then_cold"))
    return dimensions.risk_signals(m, evidence, WORDS, RECALL, OWN)


declare("mth_19", "Softmax of three values: polarity and confidence.", """
with e as (select message_id, exp(intensity * 3) as p, exp(-intensity * 3) as n, exp(0.5e0) as z from {s})
select message_id, round(greatest(p, n, z) / (p + n + z) + 1e-9, 4) as confidence, round((p - n) / (p + n + z) + 1e-9, 4) as raw_score, case when p >= n and p >= z then 1 when n >= p and n >= z then -1 else 0 end as polarity from e""")

declare("mth_20", "Calibrated confidence of facts: a clamped line and a bonus for evidence.", """
with f as (select member, count(*) as evidence, avg(s.intensity) as level from {m} m join {s} s on s.message_id = m.id group by member)
select member, round(least(0.95e0, greatest(0.2e0, 0.5 + 0.4 * level) + least(0.2e0, 0.02e0 * evidence)) + 1e-9, 4) as confidence from f""")

declare("arr_02", "Values taken from JSON text.", """
select event_id, cast(regexp_extract(props, '"k": ([0-9]+)', 1) as int) as k from {events}""")


@operator("arr_01", "select user_id, to_json(list(event_id order by event_id)) as ids, len(list(event_id)) as n from events group by 1")
def id_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of ids as JSON text and back."""
    ids = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list("event_id"))).alias("ids"))
    return ids.select("user_id", "ids", F.size(F.from_json("ids", "array<long>")).alias("n"))


#: What a model may make of an object with a kind, a number and a word that it quotes; the last one is cut off, and one tells nothing.
_ANSWERS = (
    'Result: {"kind": "%s", "k": %s, "said": "plain"} done', 'Sure! ```json {"kind": "%s", "k": %s, "said": "he "really" said so",} ```', '<think>like {"kind": "none", "k": 0}</think> {"kind": "%s", "k": %s, "said": "two\nlines"}',
    '{"kind": "none", "k": 0} no, rather {"kind": "%s", "list": [1, 2,], "k": %s, "said": "x"', "nothing: %s %s", '{"kind": "%s", "k": %s, "said": "cut of',
)
_SAID = ("plain", 'he "really" said so', "two\nlines", "x", None, "cut of")


@operator("arr_03", f"""select event_id, case when event_id % 6 <> 4 then event_type end as kind, case when event_id % 6 <> 4 then cast(props->>'k' as int) end as k,
  case event_id % 6 {" ".join(f"when {i} then '" + said.replace(chr(10), "' || chr(10) || '") + "'" for i, said in enumerate(_SAID) if said)} end as said from events""")
def tolerant_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object within a model's answer: in a fence, after reasoning, with unescaped quotes, stray commas or a cut-off end; null where there is none."""
    number = F.regexp_extract("props", "[0-9]+", 0)
    answer = F.element_at(F.array(*(F.format_string(a, F.col("event_type"), number) for a in _ANSWERS)), (F.col("event_id") % len(_ANSWERS) + 1).cast("int"))
    found = table(spark, sf_dir, "events").select("event_id", F.from_json(tolerant_json(answer), "kind string, k int, said string").alias("o"))
    return found.select("event_id", "o.kind", "o.k", "o.said")


@operator("arr_04", "select vec_id, case when vec_id % 10 = 9 then 3 else 4 + 2 * len(embedding) end as bytes, case when vec_id % 10 = 9 then 0 else len(embedding) end as dims from embeddings")
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors packed as half-precision numbers behind a magic word, and unpacked; rows that aren't such give empty ones."""
    from parley.functions.vectors import pack, unpack

    packed = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 9, F.lit(b"bad")).otherwise(pack("embedding")).alias("data"))
    return packed.select("vec_id", F.length("data").alias("bytes"), F.size(unpack("data")).alias("dims"))


_CAST = "list_transform({}, lambda x: cast(x as double))"


@operator("arr_05", f"select a.vec_id, round(list_cosine_similarity({_CAST.format('a.embedding')}, {_CAST.format('b.embedding')}) + 1e-9, 4) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def neighbour_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector and the one with the next id."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(other, "vec_id").select("vec_id", rounded(cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


@operator("arr_06", with_views(['tokens'], """
with t as (select doc_id, token, count(*) as n from tokens group by 1, 2), l as (select doc_id, sqrt(sum(n * n)) as norm from t group by 1),
d as (select a.doc_id, cast(sum(a.n * b.n) as double) as shared from t a join t b on b.token = a.token and b.doc_id = a.doc_id + 1 group by 1)
select d.doc_id, round(d.shared / (x.norm * y.norm) + 1e-9, 4) as cosine from d join l x on x.doc_id = d.doc_id join l y on y.doc_id = d.doc_id + 1"""))
def neighbour_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of word counts of neighbouring documents."""
    found = words.neighbour_products(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", rounded(F.col("shared") / (F.sqrt("own") * F.sqrt("next"))).alias("cosine"))



@operator("arr_07", "select label, p as pos, round(avg(cast(embedding[p + 1] as double)) + 1e-9, 4) as mean from embeddings, unnest(range(len(embedding))) as x(p) group by 1, 2")
def mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label, a row per place."""
    return table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(rounded(F.avg(F.col("x").cast("double"))).alias("mean"))


declare("arr_08", "Counts merged into fixed columns.", """
select conversation_id, count(case when message_type = 1 then 1 end) as texts, count(case when message_type = 43 then 1 end) as videos, count(case when message_type = 47 then 1 end) as stickers, count(case when message_type = 10000 then 1 end) as notices from {m} group by 1""")
