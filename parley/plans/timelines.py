"""Windows and order-dependent scans: units, pairs, sessions, replies, streaks, samples and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.numbers import dot, rounded
from parley.operators import timeline
from parley.operators.engagement import LONG_PAUSE, greeting, spans_deep_night, texts_of
from parley.plans.ctes import PAIRS, REPLIES, SESSIONS, UNITS, WORDS
from parley.registry import declare, operator
from parley.views import S, M, covered, messages, sentiment, table

KEY, ORDER = ["conversation_id"], ["ts", "id"]

declare("win_01", "Days that begin between five and ten and days that end from ten at night on, by the side of the first and the last message.", """
with r as (select conversation_id, is_sender, ts, row_number() over (partition by conversation_id, cast(ts as date) order by ts, id) as first,
  row_number() over (partition by conversation_id, cast(ts as date) order by ts desc, id desc) as last from {m})
select conversation_id, is_sender, count(case when first = 1 and hour(ts) >= 5 and hour(ts) < 10 then 1 end) as mornings, count(case when last = 1 and hour(ts) >= 22 then 1 end) as nights from r group by 1, 2""")


@operator("win_02", f"""with {M.replace('user_id // 30', 'user_id')}, p as (select *, ts_sec - lag(ts_sec) over (partition by conversation_id order by ts, id) as gap from m)
select conversation_id, max(gap) as gap_sec, min_by(ts_sec - gap, (-gap, ts_sec)) as from_sec, round(max(gap) / 86400.0 + 1e-9, 1) as days from p where gap >= 86400 group by 1""")
def longest_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest pause of a day or more, the earliest of equals."""
    linked = timeline.with_previous(timeline.with_day(messages(spark, sf_dir, sparse=True)), ["ts_sec"], KEY, ORDER)
    gap = F.col("ts_sec") - F.col("prev_ts_sec")
    best = linked.where(gap >= timeline.DAY).groupBy("conversation_id").agg(F.max(F.struct(gap.alias("gap"), (-F.col("prev_ts_sec")).alias("from"))).alias("b"))
    return best.select("conversation_id", F.col("b.gap").alias("gap_sec"), (-F.col("b.from")).alias("from_sec"), rounded(F.col("b.gap") / 86400.0, 1).alias("days"))


_STREAKS = """d as (select distinct conversation_id, cast(ts as date) as day from m), i as (select *, day - cast(row_number() over (partition by conversation_id order by day) as int) as anchor from d),
k as (select conversation_id, min(day) as first_day, max(day) as last_day, count(*) as days from i group by conversation_id, anchor)"""


@operator("win_03", f"with {M.replace('user_id // 30', 'user_id')}, {_STREAKS} select conversation_id, max(days) as days, min_by(first_day, (-days, first_day)) as first_day from k group by 1")
def longest_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of days with messages, the earliest of equals."""
    days = messages(spark, sf_dir, sparse=True).select("conversation_id", F.to_date("ts").alias("day")).distinct()
    best = timeline.streaks(days, KEY).groupBy("conversation_id").agg(F.min(F.struct((-F.col("days")).alias("n"), "first_day")).alias("b"))
    return best.select("conversation_id", (-F.col("b.n")).alias("days"), F.col("b.first_day").alias("first_day"))


@operator("win_04", f"""with {M.replace('user_id // 30', 'user_id')}, {_STREAKS} select conversation_id, max(days) as longest, case when max(last_day) >= date '2024-01-29' then max_by(days, last_day) else 0 end as current from k group by 1""")
def current_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of days, and the one that reaches the last day or the day before, else 0."""
    days = messages(spark, sf_dir, sparse=True).select("conversation_id", F.to_date("ts").alias("day")).distinct()
    last = F.when(F.max("last_day") >= F.to_date(F.lit("2024-01-29")), F.max_by("days", "last_day")).otherwise(0)
    return timeline.streaks(days, KEY).groupBy("conversation_id").agg(F.max("days").alias("longest"), last.alias("current"))


declare("win_05", "A sample of exactly 50 messages at equal strides.", """
with r as (select conversation_id, id, row_number() over (partition by conversation_id order by ts, id) as rn, count(*) over (partition by conversation_id) as total from {m})
select conversation_id, id from r where (rn * 50) % total < 50""")

declare("win_06", "Every k-th message, so that at most 50 are left.", """
with r as (select conversation_id, id, row_number() over (partition by conversation_id order by ts, id) as rn, count(*) over (partition by conversation_id) as total from {m})
select conversation_id, id from r where (rn - 1) % greatest(1, (total + 49) {div} 50) = 0""")


@operator("win_07", f"with {M}, {UNITS} select conversation_id, unit_id, is_sender, start_sec, end_sec, n_messages, n_chars, array_to_string(message_ids, ',') as message_ids from u")
def speech_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech units: one side's messages with less than five minutes between neighbours."""
    ids = F.array_join(F.transform("message_ids", lambda x: x.cast("string")), ",")
    return timeline.speech_units(messages(spark, sf_dir)).select("conversation_id", "unit_id", "is_sender", "start_sec", "end_sec", "n_messages", "n_chars", ids.alias("message_ids"))


_AFFECT = """a as (select u.conversation_id, u.unit_id, cast(greatest(-1, least(1, round(avg(s.polarity) + 1e-9))) as int) as polarity, round(avg(s.intensity) + 1e-9, 2) as intensity
  from u, unnest(message_ids) as x(id) left join s on s.message_id = x.id and s.message_id % 4 <> 3 group by 1, 2)"""


def unit_affect(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = timeline.speech_units(messages(spark, sf_dir)).select("conversation_id", "unit_id", F.explode("message_ids").alias("message_id"))
    joined = units.join(covered(spark, sf_dir), "message_id", "left")
    polarity = F.greatest(F.lit(-1), F.least(F.lit(1), rounded(F.avg("polarity"), 0))).cast("int")
    return joined.groupBy("conversation_id", "unit_id").agg(F.coalesce(polarity, F.lit(0)).alias("polarity"), F.coalesce(rounded(F.avg("intensity"), 2), F.lit(0.0)).alias("intensity"))


@operator("win_08", f"""with {M}, {S}, {UNITS}, {PAIRS}, {_AFFECT} select p.conversation_id, p.from_unit, p.to_unit, p.gap_sec, coalesce(a.polarity, 0) as from_polarity, coalesce(b.polarity, 0) as to_polarity,
  coalesce(a.polarity, 0) = -1 as negative_start, coalesce(a.polarity, 0) = -1 and coalesce(b.polarity, 0) >= 0 as empathetic
from pairs p join a on a.conversation_id = p.conversation_id and a.unit_id = p.from_unit join a b on b.conversation_id = p.conversation_id and b.unit_id = p.to_unit""")
def pairs_with_affect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring units of different sides with the affect of both."""
    affect = unit_affect(spark, sf_dir)
    first, second = (affect.select("conversation_id", F.col("unit_id").alias(u), F.col("polarity").alias(p)) for u, p in (("from_unit", "from_polarity"), ("to_unit", "to_polarity")))
    pairs = timeline.interaction_pairs(messages(spark, sf_dir)).select("conversation_id", F.col("prev_unit_id").alias("from_unit"), F.col("unit_id").alias("to_unit"), "gap_sec")
    joined = pairs.join(first, ["conversation_id", "from_unit"]).join(second, ["conversation_id", "to_unit"])
    negative = F.col("from_polarity") == -1
    return joined.select("conversation_id", "from_unit", "to_unit", "gap_sec", "from_polarity", "to_polarity", negative.alias("negative_start"), (negative & (F.col("to_polarity") >= 0)).alias("empathetic"))


@operator("win_09", f"with {M}, {S}, {UNITS}, {_AFFECT} select conversation_id, unit_id, coalesce(polarity, 0) as polarity, coalesce(intensity, 0.0) as intensity from a")
def affect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affect of each unit: its messages' mean, 0 without any."""
    return unit_affect(spark, sf_dir)


@operator("win_10", f"with {M}, {UNITS}, {SESSIONS} select conversation_id, session_id, start_sec, end_sec, unit_count, message_count, initiator from sess")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions: cut at pauses of more than half an hour and at nights."""
    return timeline.sessions(messages(spark, sf_dir)).select("conversation_id", "session_id", "start_sec", "end_sec", "unit_count", "message_count", "initiator")


_SIMS = """v as (select vec_id, embedding from embeddings), nv as (select count(*) as k from embeddings),
e as (select u.conversation_id, u.unit_id, v.embedding from u, nv join v on v.vec_id = u.message_ids[1] % nv.k),
sim as (select conversation_id, unit_id, list_dot_product(list_transform(embedding, lambda x: cast(x as double)), list_transform(lag(embedding) over (partition by conversation_id order by unit_id), lambda x: cast(x as double))) as sim from e),
cut as (select conversation_id, unit_id, round(sim + 1e-9, 4) as sim, sim = min(sim) over w and count(sim) over w >= 3 and sim < 0.3 as split from sim window w as (partition by conversation_id order by unit_id rows between 5 preceding and 5 following))"""


@operator("win_11", f"with {M}, {UNITS}, {_SIMS} select conversation_id, unit_id, sim, coalesce(split, false) as split from cut")
def semantic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a unit is least like the one before among its neighbours within five, and below 0.3.

    Units stand in for vectors by their first message's id. Windows run over blocks of 64 units, each with its
    neighbours of the next and the previous block, not over whole conversations.
    """
    units, vectors = timeline.speech_units(messages(spark, sf_dir)), table(spark, sf_dir, "embeddings")
    n = vectors.count()
    placed = units.select("conversation_id", "unit_id", (F.col("message_ids")[0] % n).alias("vec_id")).join(vectors.select("vec_id", "embedding"), "vec_id")
    blocks = placed.select("*", F.explode(F.expr("array(unit_id div 64 - 1, unit_id div 64, unit_id div 64 + 1)")).alias("block")).where("unit_id between block * 64 - 6 and block * 64 + 69")
    own = Window.partitionBy("conversation_id", "block").orderBy("unit_id")
    sim = blocks.withColumn("sim", dot(F.col("embedding"), F.lag("embedding").over(own))).where("unit_id >= block * 64 - 5")
    near = own.rowsBetween(-5, 5)
    split = (F.col("sim") == F.min("sim").over(near)) & (F.count("sim").over(near) >= 3) & (F.col("sim") < 0.3)
    marked = sim.withColumn("split", F.coalesce(split, F.lit(False))).where("block = unit_id div 64")
    return marked.select("conversation_id", "unit_id", rounded(F.col("sim")).alias("sim"), "split")


_FRAGMENTS = """fa as (select *, lag(end_sec) over (partition by conversation_id order by session_id) as pe from sess),
fb as (select *, sum(case when start_sec - pe <= 1800 then 0 else 1 end) over (partition by conversation_id order by session_id) as chain, unit_count < 3 as short from fa),
fc as (select *, sum(case when short then 0 else 1 end) over w as run, row_number() over w = 1 as first, lead(session_id) over w is null as last from fb window w as (partition by conversation_id, chain order by session_id)),
fd as (select *, short and (row_number() over (partition by conversation_id, chain, run, short order by session_id)) % 2 = 1 as odd from fc),
fe as (select *, coalesce(lag(odd and not last) over w, false) or (odd and last and not first) as joined from fd window w as (partition by conversation_id, chain order by session_id)),
ff as (select *, sum(case when joined then 0 else 1 end) over (partition by conversation_id, chain order by session_id) as part from fe)"""


@operator("win_13", f"""with {M}, {UNITS}, {SESSIONS}, {_FRAGMENTS} select conversation_id, min(session_id) as first_session, min(start_sec) as start_sec, max(end_sec) as end_sec,
  cast(sum(unit_count) as bigint) as unit_count, count(*) as merged from ff group by conversation_id, chain, part""")
def merged_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions after short ones (fewer than three units) have been merged, left to right.

    A short session joins the next one if the pause allows, the last one the one before, and what has been joined is not
    looked at again. In a run of short sessions every other one therefore joins its successor, which windows can say;
    they run over chains of sessions with short pauses, since a longer pause stops every merge.
    """
    s = timeline.sessions(messages(spark, sf_dir)).withColumn("day", F.to_date("start_ts"))
    chained = timeline.with_runs(s, "chain", ["start_sec", "end_sec"], F.col("start_sec") - F.col("prev_end_sec") > timeline.SESSION_GAP, KEY, ["session_id"])
    chain = Window.partitionBy("conversation_id", "chain").orderBy("session_id")
    short = F.col("unit_count") < 3
    rows = chained.withColumns({"short": short, "run": F.sum(F.when(short, 0).otherwise(1)).over(chain), "first": F.row_number().over(chain) == 1, "last": F.lead("session_id").over(chain).isNull()})
    rows = rows.withColumn("odd", F.col("short") & (F.row_number().over(Window.partitionBy("conversation_id", "chain", "run", "short").orderBy("session_id")) % 2 == 1))
    joined = F.coalesce(F.lag(F.col("odd") & ~F.col("last")).over(chain), F.lit(False)) | (F.col("odd") & F.col("last") & ~F.col("first"))
    rows = rows.withColumn("joined", joined).withColumn("part", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(chain))
    return rows.groupBy("conversation_id", "chain", "part").agg(
        F.min("session_id").alias("first_session"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.sum("unit_count").alias("unit_count"), F.count("*").alias("merged")
    ).drop("chain", "part")


@operator("win_14", f"""with {M}, b as (select *, lag(ts) over w as pt from m window w as (partition by conversation_id order by ts, id)),
r as (select *, sum(case when pt is null or ts_sec - cast(floor(epoch(pt)) as bigint) > 1800 or cast(pt as date) <> cast(ts as date) or (hour(pt) < 7 and hour(ts) >= 7) then 1 else 0 end) over (partition by conversation_id order by ts, id) as sid from b)
select conversation_id, cast(sid as bigint) as session_id, min(ts_sec) as start_sec, max(ts_sec) as end_sec, count(*) as n from r group by 1, 2""")
def message_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of plain messages by the same pauses."""
    rows = timeline.session_ids(messages(spark, sf_dir))
    return rows.groupBy("conversation_id", "session_id").agg(F.min("ts_sec").alias("start_sec"), F.max("ts_sec").alias("end_sec"), F.count("*").alias("n"))


@operator("win_15", f"with {M}, {REPLIES} select conversation_id, sent_id, reply_id, direction, abnormal, case when abnormal then null else raw end as seconds from (select *, (select 1) as one from replies) r join (select id, raw from rt) x on x.id = r.reply_id")
def response_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in both directions with the plain seconds between."""
    linked = timeline.with_previous(timeline.with_day(messages(spark, sf_dir)), ["is_sender", "ts_sec", "id"], KEY, ORDER)
    raw = F.col("ts_sec") - F.col("prev_ts_sec")
    abnormal = (raw < 0) | (raw > timeline.DAY)
    return linked.where("prev_is_sender <> is_sender").select(
        "conversation_id", F.col("prev_id").alias("sent_id"), F.col("id").alias("reply_id"), F.when(F.col("prev_is_sender") == 1, "me_to_other").otherwise("other_to_me").alias("direction"),
        abnormal.alias("abnormal"), F.when(~abnormal, raw).alias("seconds"),
    )


@operator("win_16", f"with {M}, {REPLIES} select conversation_id, sent_id, reply_id, direction, abnormal, response_sec from replies")
def response_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in both directions, nights taken off where slept through."""
    return timeline.response_times(messages(spark, sf_dir)).drop("ts")


@operator("win_17", f"""with {M}, p as (select *, lag(is_sender) over (partition by conversation_id order by ts, id) as ps from m), r as (select *, sum(case when ps = is_sender then 0 else 1 end) over (partition by conversation_id order by ts, id) as run from p)
select conversation_id, cast(run as bigint) as run, min(is_sender) as is_sender, count(*) as length, min(ts_sec) as start_sec from r group by 1, 2 having count(*) >= 3""")
def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three messages or more of one side."""
    runs = timeline.with_runs(timeline.with_day(messages(spark, sf_dir)), "run", ["is_sender"], F.col("prev_is_sender") != F.col("is_sender"), KEY, ORDER)
    return runs.groupBy("conversation_id", "run").agg(F.min("is_sender").alias("is_sender"), F.count("*").alias("length"), F.min("ts_sec").alias("start_sec")).where("length >= 3")


@operator("win_18", f"""with {M.replace('user_id // 30', 'user_id')}, p as (select *, lag(is_sender) over w as ps, lag(ts_sec) over w as a, ts_sec as b from m window w as (partition by conversation_id order by ts, id))
select conversation_id, id, is_sender, b - a as gap_sec, case when b - a > 86400 then 'ice_break' else 'long_unanswered' end as kind from p
where ps <> is_sender and (b - a > 86400 or (b - a > 7200 and len(list_filter(generate_series(a // 3600, b // 3600), lambda x: x * 3600 > a and x * 3600 < b and x % 24 between 2 and 6)) = 0))""")
def pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauses that end with the other side: of more than a day, or of more than two hours without deep night."""
    linked = timeline.with_previous(timeline.with_day(messages(spark, sf_dir, sparse=True)), ["is_sender", "ts_sec"], KEY, ORDER).where("prev_is_sender <> is_sender")
    gap = F.col("ts_sec") - F.col("prev_ts_sec")
    spans = linked.where((gap > timeline.DAY) | ((gap > LONG_PAUSE) & ~spans_deep_night(F.col("prev_ts_sec"), F.col("ts_sec"))))
    return spans.select("conversation_id", "id", "is_sender", gap.alias("gap_sec"), F.when(gap > timeline.DAY, "ice_break").otherwise("long_unanswered").alias("kind"))


@operator("win_19", f"""with {M}, g as (select distinct conversation_id, is_sender, cast(ts as date) as day, case when starts_with(content, 'view') then 'morning' else 'night' end as kind
  from m where message_type = 1 and length(trim(content)) <= 14 and (starts_with(content, 'view') or starts_with(content, 'click'))) select conversation_id, is_sender, kind, count(*) as days from g group by 1, 2, 3""")
def greetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greetings of each side in the morning and at night, once per day and kind."""
    texts = timeline.with_day(texts_of(messages(spark, sf_dir)))
    kind = F.when(greeting(F.col("content"), WORDS, "morning"), "morning").when(greeting(F.col("content"), WORDS, "night"), "night")
    return texts.withColumn("kind", kind).where("kind is not null").groupBy("conversation_id", "is_sender", "kind").agg(F.count_distinct("day").alias("days"))


@operator("win_20", f"""with {M}, p as (select *, lag(is_sender) over w as ps, lag(ts_sec) over w as pt from m window w as (partition by conversation_id, date_trunc('week', ts) order by ts, id))
select conversation_id, cast(date_trunc('week', ts) as date) as week, count(*) as chances, count(*) filter (where ts_sec - pt <= 1800) as hits from p where is_sender = 1 and ps = 0 group by 1, 2""")
def reply_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own messages right after one of the peer within the same week, and those within half an hour."""
    weekly = messages(spark, sf_dir).withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    linked = timeline.with_previous(timeline.with_day(weekly), ["is_sender", "ts_sec"], ["conversation_id", "week"], ORDER)
    return linked.where("is_sender = 1 and prev_is_sender = 0").groupBy("conversation_id", "week").agg(F.count("*").alias("chances"), F.count_if(F.col("ts_sec") - F.col("prev_ts_sec") <= 1800).alias("hits"))


@operator("win_21", f"""with {M}, {S}, n as (select distinct a.conversation_id, a.id from m a join m b on b.conversation_id = a.conversation_id and a.is_sender = 1 and b.is_sender = 0 and (b.ts, b.id) < (a.ts, a.id) and a.ts_sec - b.ts_sec <= 1800)
select n.conversation_id, count(*) as answers, round(avg(case when s.polarity = 1 then 1e0 else 0e0 end) + 1e-9, 4) as positive_rate from n join s on s.message_id = n.id group by 1""")
def positive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among own messages with one of the peer in the half hour before, the share of positive ones."""
    from parley.plans.joins import nearest_peer

    joined = nearest_peer(spark, sf_dir).join(sentiment(spark, sf_dir), F.col("id") == F.col("message_id"))
    return joined.groupBy("conversation_id").agg(F.count("*").alias("answers"), rounded(F.avg(F.when(F.col("polarity") == 1, 1.0).otherwise(0.0))).alias("positive_rate"))


declare("win_22", "The largest fall and rise between neighbouring days with enough messages.", """
with d as (select m.conversation_id, cast(m.ts as date) as day, round(avg(s.intensity) + 1e-9, 4) as level, count(*) as n from {m} m join {s} s on s.message_id = m.id group by 1, 2),
g as (select conversation_id, day, round(level - lag(level) over (partition by conversation_id order by day), 4) as delta from d where n >= 30),
r as (select *, row_number() over (partition by conversation_id, delta > 0 order by abs(delta) desc, day) as k from g where delta <> 0)
select conversation_id, day, delta, case when delta > 0 then 'rise' else 'fall' end as kind from r where k = 1""")

declare("win_23", "Milestones: the first, the hundredth, the thousandth message and so on.", """
with r as (select conversation_id, id, ts_sec, row_number() over (partition by conversation_id order by ts, id) as n from {m}) select conversation_id, id, ts_sec, n from r where n in (1, 100, 500, 1000, 2000, 5000, 10000)""")

declare("win_24", "Warm, then cold: mean messages of the first and the last third of active days.", """
with d as (select conversation_id, cast(ts as date) as day, count(*) as n from {ms} group by 1, 2),
r as (select *, row_number() over (partition by conversation_id order by day) as k, count(*) over (partition by conversation_id) as days from d)
select conversation_id, max(days) as days, round(avg(case when k <= days {div} 3 then n end) + 1e-9, 4) as first_third, round(avg(case when k > days - days {div} 3 then n end) + 1e-9, 4) as last_third from r where days >= 6 group by 1""")

declare("win_25", "A rate in the first and in the second half of the messages.", """
with r as (select conversation_id, content like '%: 7%' as hit, row_number() over (partition by conversation_id order by ts, id) as k, count(*) over (partition by conversation_id) as n from {ms})
select conversation_id, round(avg(case when k <= n {div} 2 then case when hit then 1e0 else 0e0 end end) + 1e-9, 4) as first_half, round(avg(case when k > n {div} 2 then case when hit then 1e0 else 0e0 end end) + 1e-9, 4) as second_half from r group by 1""")


@operator("win_26", """with r as (select conv_id, turn, list(left(text, 60)) over (partition by conv_id order by turn rows between 3 preceding and 1 preceding) as before from conversations)
select conv_id, turn, array_to_string(coalesce(before, []), ' / ') as context from r""")
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of up to three turns before, sixty characters each."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.collect_list(F.substring("text", 1, 60)).over(before), " / ").alias("context"))


@operator("win_27", f"""with {M.replace('user_id // 30', 'user_id')}, n as (select conversation_id, cast(date_trunc('week', ts) as date) as week, count(*) as n from m where id % 7 <> 1 group by 1, 2),
w as (select conversation_id, cast(unnest(generate_series(cast(min(week) as timestamp), cast(max(week) as timestamp), interval 7 day)) as date) as week from n group by 1)
select conversation_id, week, coalesce(n, 0) as n from w left join n using (conversation_id, week)""")
def weeks_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per week with the empty weeks between the first and the last."""
    n = messages(spark, sf_dir, sparse=True).where("id % 7 <> 1").groupBy("conversation_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("n"))
    weeks = n.groupBy("conversation_id").agg(F.min("week").alias("a"), F.max("week").alias("b")).select("conversation_id", F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week"))
    return weeks.join(n, ["conversation_id", "week"], "left").na.fill(0, ["n"])


declare("win_28", "The first sixty messages of each day, clipped; the newest days that fit the budget of 7000 characters.", """
with r as (select conversation_id, cast(ts as date) as day, id, least(length(content), 120) as chars, row_number() over (partition by conversation_id, cast(ts as date) order by ts, id) as k from {m}),
d as (select conversation_id, day, cast(sum(chars) as bigint) as chars, count(*) as n from r where k <= 60 group by 1, 2),
b as (select *, cast(sum(chars) over (partition by conversation_id order by day desc) as bigint) as used from d) select conversation_id, day, n, chars, used from b where used <= 7000""")

declare("win_29", "Indices of a month's sample: 100 spread evenly.", """
with r as (select conversation_id, id, row_number() over (partition by conversation_id, date_trunc('month', ts) order by ts, id) - 1 as k, count(*) over (partition by conversation_id, date_trunc('month', ts)) as n from {m})
select conversation_id, id, k from r where n <= 100 or (k * 100 + 99) {div} n * n {div} 100 = k and ((k * 100 + n - 1) {div} n) < 100""")

declare("win_30", "The latest score at or before a moment.", """
with w as (select m.conversation_id, cast(m.ts as date) as day, round(avg(s.intensity) + 1e-9, 4) as score from {m} m join {s} s on s.message_id = m.id group by 1, 2)
select conversation_id, max(day) as day, max_by(score, day) as score from w where day <= date '2024-01-16' group by 1""")

declare("win_31", "The newest three snapshots of each key.", """
with r as (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_orderdate desc, o_orderkey desc) as k from {orders} join {customer} on c_custkey = o_custkey) select c_custkey, o_orderkey, k from r where k <= 3""")

declare("win_32", "What is left of a cache that keeps its newest 300 rows.", """
select vec_id, label from {embeddings} order by vec_id desc limit 300""")

declare("win_33", "Three quotes spread over time: positive, of a fitting length, at strides of a third.", """
with r as (select m.conversation_id, m.id, row_number() over (partition by m.conversation_id order by m.ts, m.id) - 1 as k, count(*) over (partition by m.conversation_id) as n
  from {m} m join {s} s on s.message_id = m.id where s.polarity = 1 and length(m.content) between 10 and 50)
select conversation_id, id from r where k % greatest(1, n {div} 3) = 0 and k {div} greatest(1, n {div} 3) < 3""")


