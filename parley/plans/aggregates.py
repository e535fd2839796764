"""Aggregates over timelines: sentiment series, activity, sessions, replies, calendars and counters.

Texts of declared queries run on both engines. Averages are rounded with ties nudged upwards, since sums in another
order may differ in their last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.numbers import rounded
from parley.functions.text import any_of
from parley.operators import engagement as engaged
from parley.operators import timeline, words
from parley.plans.ctes import ENGAGED, OWN, PAIRS, RECALL, REPLIES, SESSIONS, UNITS, WORDS
from parley.registry import declare, operator
from parley.views import M, S, messages, sentiment, table, with_views

declare("agg_02", "Summary of the daily series: weighted mean, best and worst day, the earliest of equals.", """
with days as (select m.conversation_id, cast(m.ts as date) as day, round(avg(s.intensity) + 1e-9, 4) as level, sum(s.intensity) as total, count(*) as n from {m} m join {s} s on s.message_id = m.id group by 1, 2),
r as (select *, row_number() over (partition by conversation_id order by level desc, day) as best, row_number() over (partition by conversation_id order by level, day) as worst from days)
select conversation_id, round(sum(total) / sum(n) + 1e-9, 4) as mean, max(case when best = 1 then day end) as best_day, max(case when worst = 1 then day end) as worst_day from r group by conversation_id""")

declare("agg_03", "Messages per day and side.", """
select conversation_id, cast(ts as date) as day, count(case when is_sender = 1 then 1 end) as mine, count(case when is_sender = 0 then 1 end) as theirs from {m} group by 1, 2""")

declare("agg_04", "Share of each day's messages that have sentiment, marked where it is low.", """
with f as (select conversation_id, cast(ts as date) as day, count(*) as n from {m} group by 1, 2),
k as (select m.conversation_id, cast(m.ts as date) as day, count(*) as n, avg(c.intensity) as level from {m} m join {c} c on c.message_id = m.id group by 1, 2)
select f.conversation_id, f.day, f.n, coalesce(k.n, 0) as covered, round(coalesce(k.n, 0) * 1.0 / f.n + 1e-9, 4) as coverage, round(k.level + 1e-9, 4) as level,
  coalesce(k.n, 0) * 10 < f.n * 6 as low_confidence from f left join k on k.conversation_id = f.conversation_id and k.day = f.day""")

declare("agg_05", "Messages and their polarity.", """
select m.conversation_id, count(*) as total, count(case when c.polarity = 1 then 1 end) as positive, count(case when c.polarity = -1 then 1 end) as negative,
  count(case when c.polarity = 0 then 1 end) as neutral from {m} m left join {c} c on c.message_id = m.id group by 1""")

declare("agg_06", "First and last time, days between, days with messages.", """
select conversation_id, min(ts_sec) as first_sec, max(ts_sec) as last_sec, round((max(ts_sec) - min(ts_sec)) / 86400.0 + 1e-9, 2) as duration_days, count(distinct cast(ts as date)) as active_days
from {m} group by 1""")

declare("agg_07", "Characters of valid texts.", """
select conversation_id, count(*) as n, cast(sum(length(content)) as bigint) as chars, round(avg(length(content)) + 1e-9, 4) as mean_chars from {m} where message_type = 1 and length(trim(content)) >= 2 group by 1""")


@operator("agg_01", f"""with {M}, {S} select conversation_id, strftime(ts, '%Y-%m-%d') as bucket, round(avg(intensity) + 1e-9, 4) as avg_intensity,
  count(*) filter (where polarity = 1) as positive, count(*) filter (where polarity = -1) as negative, count(*) filter (where polarity = 0) as neutral,
  round(avg(case when is_sender = 1 then intensity end) + 1e-9, 4) as my_avg, round(avg(case when is_sender = 0 then intensity end) + 1e-9, 4) as other_avg,
  count(*) filter (where is_sender = 1) as my_count, count(*) filter (where is_sender = 0) as other_count
from m join s on s.message_id = m.id group by 1, 2""")
def sentiment_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation and day: average intensity, counts by polarity, and both per side."""
    joined = messages(spark, sf_dir).join(sentiment(spark, sf_dir), F.col("id") == F.col("message_id"))
    mine = F.col("is_sender") == 1
    return joined.groupBy("conversation_id", F.date_format("ts", "yyyy-MM-dd").alias("bucket")).agg(
        rounded(F.avg("intensity")).alias("avg_intensity"), F.count_if(F.col("polarity") == 1).alias("positive"), F.count_if(F.col("polarity") == -1).alias("negative"),
        F.count_if(F.col("polarity") == 0).alias("neutral"), rounded(F.avg(F.when(mine, F.col("intensity")))).alias("my_avg"),
        rounded(F.avg(F.when(~mine, F.col("intensity")))).alias("other_avg"), F.count_if(mine).alias("my_count"), F.count_if(~mine).alias("other_count"),
    )


@operator("agg_08", f"""with {M}, {UNITS}, {SESSIONS}, g as (select *, start_sec - lag(end_sec) over (partition by conversation_id order by session_id) as gap from sess)
select conversation_id, count(*) as sessions, round(avg(unit_count) + 1e-9, 4) as mean_units, round(avg(gap) + 1e-9, 4) as mean_gap from g group by 1""")
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of sessions, mean units, mean pause between sessions."""
    s = timeline.sessions(messages(spark, sf_dir)).withColumn("day", F.to_date("start_ts"))
    linked = timeline.with_previous(s, ["end_sec"], ["conversation_id"], ["session_id"])
    return linked.groupBy("conversation_id").agg(F.count("*").alias("sessions"), rounded(F.avg("unit_count")).alias("mean_units"), rounded(F.avg(F.col("start_sec") - F.col("prev_end_sec"))).alias("mean_gap"))


@operator("agg_09", f"""with {M}, {UNITS}, {SESSIONS} select conversation_id, count(*) as sessions, count(*) filter (where initiator = 1) as mine, count(*) filter (where initiator = 0) as theirs,
  round(count(*) filter (where initiator = 1) * 1.0 / count(*) + 1e-9, 4) as my_rate from sess group by 1""")
def initiators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who begins sessions."""
    mine = F.count_if(F.col("initiator") == 1)
    return timeline.sessions(messages(spark, sf_dir)).groupBy("conversation_id").agg(F.count("*").alias("sessions"), mine.alias("mine"), F.count_if(F.col("initiator") == 0).alias("theirs"), rounded(mine / F.count("*")).alias("my_rate"))


@operator("agg_10", f"with {M}, {UNITS}, {PAIRS} select conversation_id, count(*) as pairs, round(avg(gap_sec) + 1e-9, 4) as mean_gap from pairs group by 1")
def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of pairs and mean gap."""
    return timeline.interaction_pairs(messages(spark, sf_dir)).groupBy("conversation_id").agg(F.count("*").alias("pairs"), rounded(F.avg("gap_sec")).alias("mean_gap"))


@operator("agg_11", f"""with {M}, {REPLIES} select conversation_id, direction, count(response_sec) as n, round(avg(response_sec) + 1e-9, 4) as mean, round(quantile_cont(response_sec, 0.5) + 1e-9, 4) as median,
  min(response_sec) as least, max(response_sec) as most, round(stddev_samp(response_sec) + 1e-9, 3) as deviation from replies group by 1, 2""")
def response_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response times per direction: mean, interpolated median, extremes, sample deviation."""
    r = F.col("response_sec")
    return timeline.response_times(messages(spark, sf_dir)).groupBy("conversation_id", "direction").agg(
        F.count(r).alias("n"), rounded(F.avg(r)).alias("mean"), rounded(F.percentile(r, 0.5)).alias("median"), F.min(r).alias("least"), F.max(r).alias("most"), rounded(F.stddev_samp(r), 3).alias("deviation")
    )


_BINS = (60, 600, 1800, 3600, 21600, 86400)
_BIN = "case " + " ".join(f"when response_sec < {b} then {i}" for i, b in enumerate(_BINS)) + f" else {len(_BINS)} end"


@operator("agg_12", f"""with {M}, {REPLIES}, n as (select conversation_id, count(*) as total, list(response_sec order by response_sec)[count(*) // 2 + 1] as upper_median from replies where response_sec is not null group by 1)
select conversation_id, {_BIN} as bin, count(*) as n, any_value(upper_median) as upper_median from replies join n using (conversation_id) where response_sec is not null group by 1, 2""")
def response_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response times in seven bins, with the upper of the two middle ones, found by ranks rather than a list."""
    replies = timeline.response_times(messages(spark, sf_dir)).where("response_sec is not null")
    # values with their counts first: the window then runs over distinct seconds only
    seconds = replies.groupBy("conversation_id", "response_sec").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("conversation_id").orderBy("response_sec"))
    whole = F.sum("n").over(Window.partitionBy("conversation_id"))
    middle = seconds.withColumn("upto", upto).withColumn("whole", whole).where("upto >= whole div 2 + 1").groupBy("conversation_id").agg(F.min("response_sec").alias("upper_median"))
    return seconds.groupBy("conversation_id", F.expr(_BIN).alias("bin")).agg(F.sum("n").alias("n")).join(middle, "conversation_id")


@operator("agg_13", f"with {M}, {REPLIES} select conversation_id, direction, round(quantile_cont(response_sec, 0.5) + 1e-9, 4) as median from replies where response_sec is not null group by 1, 2")
def directional_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the two middle response times per direction."""
    replies = timeline.response_times(messages(spark, sf_dir)).where("response_sec is not null")
    return replies.groupBy("conversation_id", "direction").agg(rounded(F.percentile("response_sec", 0.5)).alias("median"))


@operator("agg_14", f"""with {M}, {UNITS}, {SESSIONS}, t as (select sr.conversation_id, cast(sr.sid as bigint) as session_id, sr.is_sender, sr.n_chars from sr)
select conversation_id, session_id, cast(sum(n_chars) filter (where is_sender = 1) as bigint) as mine, cast(sum(n_chars) filter (where is_sender = 0) as bigint) as theirs,
  round(sum(n_chars) filter (where is_sender = 1) * 1.0 / sum(n_chars) + 1e-9, 4) as my_share from t group by grouping sets ((conversation_id), (conversation_id, session_id))""")
def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters by side per session, and (without session) per conversation, in one pass."""
    units = timeline.session_ids(timeline.speech_units(messages(spark, sf_dir)), start="ts", end="end_ts", order=("ts", "unit_id"))
    mine = F.sum(F.when(F.col("is_sender") == 1, F.col("n_chars")))
    sets = units.groupingSets([["conversation_id"], ["conversation_id", "session_id"]], "conversation_id", "session_id")
    return sets.agg(mine.alias("mine"), F.sum(F.when(F.col("is_sender") == 0, F.col("n_chars"))).alias("theirs"), rounded(mine / F.sum("n_chars")).alias("my_share"))


declare("agg_15", "Activity in a window of time: messages, my share in percent, late ones.", """
select conversation_id, count(*) as n, count(case when is_sender = 1 then 1 end) as mine, round(100.0 * count(case when is_sender = 1 then 1 end) / count(*) + 1e-9, 1) as my_percent,
  count(case when hour(ts) < 5 then 1 end) as late from {m} where ts >= timestamp '2024-01-08 00:00:00' and ts < timestamp '2024-01-15 00:00:00' group by 1""")

declare("agg_16", "Overview of each month: messages, characters, nights, days that begin or end with a message.", """
with e as (select conversation_id, cast(ts as date) as day, min(hour(ts)) as first_hour, max(hour(ts)) as last_hour from {m} group by 1, 2),
g as (select conversation_id, date_trunc('month', day) as month, count(case when first_hour >= 5 and first_hour < 10 then 1 end) as mornings, count(case when last_hour >= 22 then 1 end) as evenings from e group by 1, 2),
a as (select conversation_id, date_trunc('month', ts) as month, count(*) as n, count(case when is_sender = 1 then 1 end) as mine, count(case when hour(ts) < 5 then 1 end) as late,
  cast(sum(case when message_type = 1 then length(content) else 0 end) as bigint) as chars from {m} group by 1, 2)
select a.conversation_id, cast(a.month as date) as month, a.n, a.mine, a.late, a.chars, g.mornings, g.evenings from a join g on g.conversation_id = a.conversation_id and cast(g.month as date) = cast(a.month as date)""")

declare("agg_17", "Poster figures.", """
select conversation_id, count(*) as total, count(case when is_sender = 1 then 1 end) as mine, count(case when is_sender = 0 then 1 end) as theirs, count(distinct cast(ts as date)) as active_days,
  max(ts_sec) {div} 86400 - min(ts_sec) {div} 86400 + 1 as span_days from {m} group by 1""")

declare("agg_18", "The day with most messages, the earliest of equals.", """
with days as (select conversation_id, cast(ts as date) as day, count(*) as n from {m} group by 1, 2),
r as (select *, row_number() over (partition by conversation_id order by n desc, day) as k from days) select conversation_id, day, n from r where k = 1""")


@operator("agg_19", f"""with {M}, grid as (select c.conversation_id, w.w as weekday, h.h as hour from (select distinct conversation_id from m) c, range(7) as w(w), range(24) as h(h)),
n as (select conversation_id, isodow(ts) - 1 as weekday, hour(ts) as hour, count(*) as n, count(*) filter (where is_sender = 1) as mine from m group by 1, 2, 3)
select conversation_id, weekday, hour, coalesce(n, 0) as n, coalesce(mine, 0) as mine from grid left join n using (conversation_id, weekday, hour)""")
def heat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by weekday (Monday is 0) and hour, empty cells included: the grid comes from each conversation, not from a cross join."""
    m = messages(spark, sf_dir)
    n = m.groupBy("conversation_id", F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("is_sender") == 1).alias("mine"))
    cells = n.groupBy("conversation_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("weekday") * 24 + F.col("hour")).alias("k"), F.struct("n", "mine")))).alias("cells"))
    grid = cells.select("conversation_id", "cells", F.explode(F.sequence(F.lit(0), F.lit(167))).alias("k"))
    cell = F.element_at("cells", F.col("k"))
    return grid.select("conversation_id", F.expr("k div 24").alias("weekday"), (F.col("k") % 24).alias("hour"), F.coalesce(cell["n"], F.lit(0).cast("long")).alias("n"), F.coalesce(cell["mine"], F.lit(0).cast("long")).alias("mine"))


declare("agg_20", "Days of the busiest year, the earliest of equals.", """
with days as (select conversation_id, cast(ts as date) as day, count(*) as n from {m} group by 1, 2),
years as (select conversation_id, year(day) as y, cast(sum(n) as bigint) as total from days group by 1, 2),
best as (select *, row_number() over (partition by conversation_id order by total desc, y) as k from years)
select d.conversation_id, d.day, d.n from days d join best b on b.conversation_id = d.conversation_id and b.y = year(d.day) and b.k = 1""")


@operator("agg_21", f"""with {M}, {UNITS}, {SESSIONS}, days as (select conversation_id, cast(start_ts as date) as day, count(*) as sessions, cast(sum(message_count) as bigint) as messages, cast(sum(end_sec - start_sec) as bigint) as seconds from sess group by 1, 2),
k as (select *, max(messages) over w as mm, max(sessions) over w as ms, max(seconds) over w as mx from days window w as (partition by conversation_id)),
x as (select conversation_id, day, sessions, messages, round(0.45 * messages / mm + 0.40 * sessions / ms + 0.15 * seconds / greatest(1, mx) + 1e-9, 4) as score from k)
select *, case when score >= 0.75 then 4 when score >= 0.5 then 3 when score >= 0.25 then 2 else 1 end as level from x""")
def activity_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with a score of messages, sessions and time, each against the conversation's largest, and a level from 1 to 4."""
    s = timeline.sessions(messages(spark, sf_dir))
    days = s.groupBy("conversation_id", F.to_date("start_ts").alias("day")).agg(F.count("*").alias("sessions"), F.sum("message_count").alias("messages"), F.sum(F.col("end_sec") - F.col("start_sec")).alias("seconds"))
    w = Window.partitionBy("conversation_id")
    score = 0.45 * F.col("messages") / F.max("messages").over(w) + 0.40 * F.col("sessions") / F.max("sessions").over(w) + 0.15 * F.col("seconds") / F.greatest(F.lit(1), F.max("seconds").over(w))
    scored = days.withColumn("score", rounded(score))
    level = F.when(F.col("score") >= 0.75, 4).when(F.col("score") >= 0.5, 3).when(F.col("score") >= 0.25, 2).otherwise(1)
    return scored.select("conversation_id", "day", "sessions", "messages", "score", level.alias("level"))


declare("agg_22", "Members of a group: messages, characters, share, rank and busiest hour.", """
with a as (select conversation_id, member, count(*) as n, cast(sum(length(content)) as bigint) as chars from {m} group by 1, 2),
h as (select conversation_id, member, hour(ts) as hour, count(*) as k from {m} group by 1, 2, 3),
b as (select conversation_id, member, hour, row_number() over (partition by conversation_id, member order by k desc, hour) as r from h)
select a.conversation_id, a.member, a.n, a.chars, round(a.n * 1.0 / sum(a.n) over (partition by a.conversation_id) + 1e-9, 4) as share,
  row_number() over (partition by a.conversation_id order by a.n desc, a.member) as rank, b.hour as busiest_hour from a join b on b.conversation_id = a.conversation_id and b.member = a.member and b.r = 1""")

declare("agg_23", "Stickers and marks by side and month: uses, first and last.", """
select conversation_id, is_sender, message_type as kind, regexp_extract(content, '[0-9]+', 0) as key, cast(date_trunc('month', ts) as date) as month, count(*) as n, min(ts_sec) as first_sec, max(ts_sec) as last_sec
from {m} where message_type in (47, 43) group by 1, 2, 3, 4, 5""")

declare("agg_25", "Variation of the daily number of messages, from two days on.", """
with days as (select conversation_id, cast(ts as date) as day, count(*) as n from {m} group by 1, 2)
select conversation_id, count(*) as days, case when count(*) >= 2 then round(stddev_pop(n) / avg(n) + 1e-9, 4) end as variation from days group by 1""")



@operator("agg_26", f"""with {M} select conversation_id, count(*) filter (where regexp_extract(content, '{RECALL}', 1) in {OWN}) as mine,
  count(*) filter (where regexp_extract(content, '{RECALL}', 1) not in {OWN}) as theirs from m where message_type = 10000 and regexp_matches(content, '{RECALL}') group by 1""")
def recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalls by side, read from system rows."""
    return engaged.recalls(messages(spark, sf_dir), RECALL, OWN)



declare("agg_27", "Messages by side and polarity.", """
select m.conversation_id, m.is_sender, c.polarity, count(*) as n from {m} m join {c} c on c.message_id = m.id group by 1, 2, 3""")

declare("agg_28", "Spread of sentiment: population variance, share of negative ones, positive among polar ones.", """
select m.conversation_id, m.is_sender, round(var_pop(c.intensity) + 1e-9, 4) as variance, round(avg(case when c.polarity = -1 then 1e0 else 0e0 end) + 1e-9, 4) as negative_share,
  round(count(case when c.polarity = 1 then 1 end) * 1.0 / nullif(count(case when c.polarity <> 0 then 1 end), 0) + 1e-9, 4) as positive_of_polar from {m} m join {c} c on c.message_id = m.id group by 1, 2""")


@operator("agg_29", with_views(['tokens'], """
with t as (select doc_id, token, count(*) as n from tokens group by 1, 2),
w as (select *, cast(sum(n) over (partition by doc_id) as double) as whole from t)
select doc_id, cast(sum(n) as bigint) as words, count(*) as kinds, round(count(*) * 1.0 / sum(n) + 1e-9, 4) as variety,
  case when count(*) > 1 then round(-sum(n / whole * ln(n / whole)) / ln(count(*)) + 1e-9, 4) else 0.0 end as entropy from w group by doc_id"""))
def word_variety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variety of a document's words: distinct over all, and entropy over its maximum."""
    entropy = (F.ln("words") - F.col("spread") / F.col("words")) / F.ln("kinds")
    return words.variety(table(spark, sf_dir, "documents")).select(
        "doc_id", "words", "kinds", rounded(F.col("kinds") / F.col("words")).alias("variety"), F.when(F.col("kinds") > 1, rounded(entropy)).otherwise(0.0).alias("entropy")
    )



@operator("agg_30", "select lang, count(*) as n, round(avg(case when regexp_matches(text, '(?i)(^|[^\\p{L}])(the|and|of|der|die|und|le|la|des|los|que)([^\\p{L}]|$)') then 1e0 else 0e0 end) + 1e-9, 4) as density from documents group by 1")
def lexicon_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents that hold a word of a list."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    hit = F.col("text").rlike(any_of(("the", "and", "of", "der", "die", "und", "le", "la", "des", "los", "que")))
    return docs.groupBy("lang").agg(F.count("*").alias("n"), rounded(F.avg(F.when(hit, 1.0).otherwise(0.0))).alias("density"))


declare("agg_31", "Weekly features per side: messages, nights, polarity, shares.", """
select m.conversation_id, cast(date_trunc('week', m.ts) as date) as week, m.is_sender, count(*) as n, count(case when hour(m.ts) < 6 then 1 end) as late,
  count(case when c.polarity = 1 then 1 end) as positive, count(case when c.polarity = -1 then 1 end) as negative,
  count(case when m.message_type in (3, 43) or (m.message_type = 1 and m.content like '%http%') then 1 end) as shared from {m} m left join {c} c on c.message_id = m.id group by 1, 2, 3""")

declare("agg_32", "Figures of chapters of two weeks.", """
select m.conversation_id, m.ts_sec {div} 1209600 as chapter, count(*) as n, count(distinct cast(m.ts as date)) as days, round(avg(c.intensity) + 1e-9, 4) as level,
  min(m.ts_sec) as first_sec, max(m.ts_sec) as last_sec from {m} m left join {c} c on c.message_id = m.id group by 1, 2""")

declare("agg_33", "The week with most negative messages, the latest of equals.", """
with w as (select m.conversation_id, m.ts_sec {div} 604800 as week, count(*) as n from {m} m join {c} c on c.message_id = m.id where c.polarity = -1 group by 1, 2),
r as (select *, row_number() over (partition by conversation_id order by n desc, week desc) as k from w) select conversation_id, week, n from r where k = 1""")

declare("agg_34", "Counters of attitude: messages by type, marks in them by day and night, distinct holidays.", """
select conversation_id, is_sender, count(case when message_type = 1 then 1 end) as texts, count(case when message_type = 47 then 1 end) as stickers, count(case when message_type = 43 then 1 end) as videos,
  count(case when content like '%: 7%' and (hour(ts) >= 23 or hour(ts) < 5) then 1 end) as marks_at_night, count(case when content like '%: 7%' and not (hour(ts) >= 23 or hour(ts) < 5) then 1 end) as marks_by_day,
  count(distinct case when day(ts) in (1, 6, 14) then cast(ts as date) end) as holidays from {m} group by 1, 2""")

declare("agg_35", "How many messages have been analysed.", """
select m.conversation_id, count(*) as total, count(c.message_id) as covered, count(case when m.message_type = 1 then 1 end) as texts,
  count(case when m.message_type = 1 then c.message_id end) as covered_texts from {m} m left join {c} c on c.message_id = m.id group by 1""")

declare("agg_36", "A fingerprint that changes with the messages.", """
select conversation_id, count(*) as n, cast(sum(id) as bigint) as ids, max(ts_sec) as last_sec from {m} group by 1""")

declare("agg_37", "Change of the weekly level between the last two weeks that have one.", """
with w as (select m.conversation_id, date_trunc('week', m.ts) as week, avg(c.intensity) as level from {m} m join {c} c on c.message_id = m.id group by 1, 2),
r as (select *, row_number() over (partition by conversation_id order by week desc) as k from w)
select conversation_id, round(max(case when k = 1 then level end) + 1e-9, 4) as last_level, round(max(case when k = 2 then level end) + 1e-9, 4) as before,
  round(max(case when k = 1 then level end) - max(case when k = 2 then level end) + 1e-9, 4) as change from r where k <= 2 group by 1""")


@operator("agg_38", f"""with {M}, {UNITS}, {SESSIONS}, {REPLIES}, r as (select conversation_id, case when direction = 'me_to_other' then 0 else 1 end as side, quantile_cont(response_sec, 0.5) as median, avg(response_sec) as mean from replies group by 1, 2),
i as (select conversation_id, initiator as side, count(*) as begun from sess group by 1, 2), v as (select conversation_id, is_sender as side, cast(sum(length(content)) as bigint) as chars from m group by 1, 2)
select conversation_id, side, v.chars, coalesce(i.begun, 0) as begun, round(r.median + 1e-9, 4) as median, round(r.mean + 1e-9, 4) as mean from v left join i using (conversation_id, side) left join r using (conversation_id, side)""")
def mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides next to each other: characters, sessions begun, median and mean time to reply."""
    m = messages(spark, sf_dir)
    replies = timeline.response_times(m).groupBy("conversation_id", F.when(F.col("direction") == "me_to_other", 0).otherwise(1).alias("side"))
    r = replies.agg(rounded(F.percentile("response_sec", 0.5)).alias("median"), rounded(F.avg("response_sec")).alias("mean"))
    i = timeline.sessions(m).groupBy("conversation_id", F.col("initiator").alias("side")).agg(F.count("*").alias("begun"))
    v = m.groupBy("conversation_id", F.col("is_sender").alias("side")).agg(F.sum(F.length("content")).alias("chars"))
    return v.join(i, ["conversation_id", "side"], "left").join(r, ["conversation_id", "side"], "left").na.fill(0, ["begun"])


declare("agg_39", "First and last day of each conversation.", """
select conversation_id, cast(min(ts) as date) as first_day, cast(max(ts) as date) as last_day from {m} group by 1""")

_PHRASES = ("click", "view", '"k": 7', "sign")


@operator("agg_40", f"""with {M}, p as (select unnest({list(_PHRASES)}) as phrase)
select phrase, count(*) filter (where contains(content, phrase)) as n, count(*) filter (where contains(content, phrase) and is_sender = 1) as mine from m, p group by 1""")
def phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often phrases occur in messages, and in mine: each message names the phrases that it holds."""
    m = messages(spark, sf_dir)
    held = F.filter(F.array(*(F.lit(p) for p in _PHRASES)), lambda p: F.contains(F.col("content"), p))
    return m.select("is_sender", F.explode(held).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"), F.count_if(F.col("is_sender") == 1).alias("mine"))


declare("agg_41", "Characters in a window of time.", """
select conversation_id, cast(sum(length(content)) as bigint) as chars from {m} where ts >= timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-20 00:00:00' and message_type = 1 group by 1""")

declare("agg_42", "Months with their span and messages by side.", """
select conversation_id, cast(date_trunc('month', ts) as date) as month, min(ts_sec) as first_sec, max(ts_sec) as last_sec, count(case when is_sender = 1 then 1 end) as mine, count(case when is_sender = 0 then 1 end) as theirs
from {m} group by 1, 2""")


@operator("agg_24", f"with {M}, {ENGAGED} select * replace (round(perfunctory_self, 6) as perfunctory_self, round(perfunctory_other, 6) as perfunctory_other) from eng")
def engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement of both sides: bursts, long pauses, ice-breaks, greetings, togetherness, half-hearted replies."""
    found = engaged.engagement(messages(spark, sf_dir), WORDS)
    return found.withColumns({c: F.round(c, 6) for c in ("perfunctory_self", "perfunctory_other")})
