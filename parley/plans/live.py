"""Batch twins of the live rules: windows of counts and of event time, triggers, purification, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.numbers import rounded
from parley.operators import timeline
from parley.registry import declare, operator
from parley.sources import feed
from parley.streaming import attribution, late, triggers
from parley.views import LIVELY, MEDIAN, M, messages, sentiment, spoken, table

KEY, ORDER = ["conversation_id"], ["ts", "id"]

#: A log is polled so often; a screen shows times to the hour, and for some hours after a day's end what that day's last hours held.
POLL, SHOWN, AGAIN = 21_600, 3_600, 6

declare("stm_01", "What each poll brings: the rows between one frontier and the next, by conversation; polls at which nothing has grown bring none.", f"""
select conversation_id, ts_sec {{div}} {POLL} as poll, (ts_sec {{div}} {POLL} + 1) * {POLL} as frontier_sec, count(*) as n, min(id) as first_id, max(id) as last_id from {{m}} group by 1, 2, 3""")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message as the poll of its day shows it, those of a day's last hours by the next day's poll as well."""
    m = messages(spark, sf_dir).select("conversation_id", "id", F.expr(f"ts_sec div {SHOWN} * {SHOWN}").alias("ts_sec"), F.split("content", " ")[0].alias("content"), F.expr("ts_sec div 86400").alias("day"))
    late = F.expr(f"ts_sec % 86400 >= 86400 - {AGAIN} * {SHOWN}")
    return m.withColumn("poll", F.explode(F.when(late, F.array("day", F.col("day") + 1)).otherwise(F.array("day")))).drop("day")


@operator("stm_02", f"""with {M}, x as (select conversation_id, ts_sec // {SHOWN} * {SHOWN} as shown, split_part(content, ' ', 1) as content, ts_sec // 86400 as poll from m),
c as (select * from x union all select conversation_id, shown, content, poll + 1 from x where shown % 86400 >= 86400 - {AGAIN} * {SHOWN}), n as (select conversation_id, shown, content, poll, count(*) as n from c group by 1, 2, 3, 4),
w as (select *, greatest(0, n - coalesce(max(n) over (partition by conversation_id, shown, content order by poll rows between unbounded preceding and 1 preceding), 0)) as fresh from n)
select conversation_id, poll, sum(fresh)::bigint as n_new, count(*) filter (where fresh > 0) as n_messages, max(case when fresh > 0 then n end) as most from w where fresh > 0 group by 1, 2""")
def new_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New messages of overlapping polls, where equal ones of one time are told apart by their number."""
    found = feed.occurrences(captures(spark, sf_dir))
    each = found.groupBy("conversation_id", "poll", *feed.SAME[1:]).agg(F.count("*").alias("n"), F.max("occurrence").alias("most"))
    return each.groupBy("conversation_id", "poll").agg(F.sum("n").alias("n_new"), F.count("*").alias("n_messages"), F.max("most").cast("long").alias("most"))


#: Events come some twenty minutes apart and chats some seconds: their times are drawn together, and each kind is spoken as a chat's words.
HURRY, START = 40, 1_704_067_200
SPOKEN_AS = {"view": "ok", "click": "嗯嗯", "signup": "好", "error": "不了", "purchase": "tell me all about it"}
_WORDS = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in SPOKEN_AS.items()) + " end"
_PEER = f"""with recursive {M}, {LIVELY}, x as (select m.conversation_id, m.id, (m.ts_sec - {START}) // {HURRY} + {START} as ts_sec, s.polarity, s.intensity, abs(s.intensity) as sure,
  event_type = 'error' as boundary, event_type in ('view', 'click', 'signup') and s.polarity = 0 and abs(s.intensity) <= 0.25 as dull, event_type in ('view', 'click') as strong, event_type = 'purchase' as substantive
  from m join s on s.message_id = m.id join events e on e.event_id = m.id where m.is_sender = 0)"""
_ORDER = "(partition by conversation_id order by ts_sec, id)"


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peer's messages as a live chat, with what their words do; a mood counts as the surer the stronger it is."""
    kinds = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.create_map(*(F.lit(x) for p in SPOKEN_AS.items() for x in p))[F.col("event_type")].alias("content"))
    m = messages(spark, sf_dir).where("is_sender = 0").drop("content").join(kinds, "id").join(sentiment(spark, sf_dir, MEDIAN), F.col("id") == F.col("message_id"))
    hurried = F.expr(f"(ts_sec - {START}) div {HURRY} + {START}")
    m = m.select("conversation_id", "id", hurried.alias("ts_sec"), F.lit(triggers.TEXT).alias("message_type"), "content", "polarity", "intensity", F.abs("intensity").alias("confidence"))
    return triggers.marked(m)


def recent(spark: SparkSession, sf_dir: str, counts: bool = False) -> DataFrame:
    return triggers.windows(peers(spark, sf_dir), counts=counts)


#: When the stream starts, within the drawn-together month.
STARTED = START + 32_400


@operator("stm_03", f"{_PEER} select conversation_id, id, k, k = 1 and {STARTED} - ts_sec <= 600 as waits from (select *, row_number() over (partition by conversation_id order by ts_sec desc, id desc) as k from x where ts_sec <= {STARTED}) where k <= 5")
def warm_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream starts from: the last five messages of each conversation, and whether its silence is still to be waited for."""
    start = triggers.baseline(peers(spark, sf_dir), STARTED)
    k = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("ts_sec"), F.desc("id")))  # five rows
    return start.select("conversation_id", "id", k.alias("k"), ((k == 1) & (STARTED - F.col("ts_sec") <= triggers.RULES.silence)).alias("waits"))


_IDS = ("conversation_id", "id")


@operator("stm_04", f"{_PEER} select conversation_id, id, count(*) over w as n, round(avg(intensity) over w + 1e-9, 4) as level, cast(sum(polarity) over w as bigint) as polarity from x window w as (partition by conversation_id order by ts_sec, id rows between 4 preceding and current row)")
def count_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of the peer's last five messages."""
    r = recent(spark, sf_dir)
    level = F.aggregate("last", F.lit(0.0), lambda a, x: a + x["intensity"]) / F.size("last")
    return r.select(*_IDS, F.size("last").cast("long").alias("n"), rounded(level).alias("level"), F.aggregate("last", F.lit(0).cast("long"), lambda a, x: a + x["polarity"]).alias("polarity"))


_STREAK = f"st as (select *, polarity = -1 and lag(polarity) over w = -1 and lag(polarity, 2) over w = -1 as streak from x window w as {_ORDER})"


@operator("stm_05", f"{_PEER}, {_STREAK} select conversation_id, id from st where streak")
def negative_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are the third negative one in a row."""
    return recent(spark, sf_dir).where(triggers.streak()).select(*_IDS)


_SHIFT = f"""sh as (select *, polarity = -1 and not boundary and sure >= 0.6 and good >= 2 and mood >= 0.45 and base >= 0.25 and intensity <= -0.5 and base - intensity >= 0.7 and ts_sec - t3 <= 180 as shift
  from (select *, lag(ts_sec, 3) over w as t3, (lag(intensity, 3) over w + lag(intensity, 2) over w + lag(intensity) over w) / 3 as base,
  (lag(polarity) over w + lag(polarity, 2) over w + lag(polarity, 3) over w) / 3e0 as mood, (lag(polarity) over w = 1)::int + (lag(polarity, 2) over w = 1)::int + (lag(polarity, 3) over w = 1)::int as good from x window w as {_ORDER}))"""


@operator("stm_06", f"{_PEER}, {_SHIFT} select conversation_id, id, round(base - intensity + 1e-9, 4) as fall from sh where shift")
def emotion_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sure fall from three mostly positive messages within three minutes, unless it declines."""
    base = F.aggregate(F.slice("last", F.size("last") - 3, F.lit(3)), F.lit(0.0), lambda a, x: a + x["intensity"]) / 3
    r = recent(spark, sf_dir).where(triggers.shifts())
    return r.select(*_IDS, rounded(base - F.col("intensity")).alias("fall"))


_DULL = f"""du as (select *, t2 is not null and words = 3 and acks >= 2 and ts_sec - t2 <= 180 as dulls from (select *, lag(ts_sec, 2) over w as t2, sum((dull and not boundary)::int) over v as words, sum(strong::int) over v as acks
  from x window w as {_ORDER}, v as (partition by conversation_id order by ts_sec, id rows between 2 preceding and current row)))"""


@operator("stm_07", f"{_PEER}, {_DULL} select conversation_id, id from du where dulls")
def perfunctory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three calm words of consent within three minutes, two of them strong ones."""
    return recent(spark, sf_dir).where(triggers.dull()).select(*_IDS)


_HAPPY = "ha as (select *, n = 3 and p = 1 and least > 0.5 as happy from (select *, min(intensity) over w as least, min(polarity) over w as p, count(*) over w as n from x window w as (partition by conversation_id order by ts_sec, id rows between 2 preceding and current row)))"


@operator("stm_08", f"{_PEER}, {_HAPPY} select conversation_id, id from ha where happy")
def positive_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third of three clearly positive messages."""
    return recent(spark, sf_dir).where(triggers.happy()).select(*_IDS)


_COOL = f"""co as (select *, now + before >= 4 and before >= 2 and now * 2 < before and not boundary and not substantive and not (moves and ts_sec - t1 <= 120) as cools from (
  select *, count(*) over (partition by conversation_id order by ts_sec range between 299 preceding and 1 preceding) + row_number() over (partition by conversation_id, ts_sec order by id) as now,
  count(*) over (partition by conversation_id order by ts_sec range between 599 preceding and 300 preceding) as before, coalesce(lag(substantive) over w, false) as moves, coalesce(lag(ts_sec) over w, 0) as t1 from x window w as {_ORDER}))"""


@operator("stm_09", f"{_PEER}, {_COOL} select conversation_id, id, now, before from co where cools")
def cooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer than half as many messages in the last five minutes as in the five before, by event time, while the last two don't move the talk on."""
    return recent(spark, sf_dir, counts=True).where(triggers.cools()).select(*_IDS, "now", "before")


_QUIET = f"qu as (select conversation_id, id, ts_sec + 600 as ts_sec from (select *, lead(ts_sec) over {_ORDER} as next from x) where next is null or next - ts_sec > 600)"


@operator("stm_10", f"{_PEER}, {_QUIET} select conversation_id, id, ts_sec as fires_at from qu")
def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a silence of ten minutes would fire, once per pause: seen from the message that ends it, and from the last one."""
    return triggers.silences(peers(spark, sf_dir)).select(*_IDS, F.col("ts_sec").alias("fires_at"))


_KINDS = {"negative_streak": ("st", "streak"), "emotion_shift": ("sh join st using (conversation_id, id)", "shift and not streak"), "perfunctory": ("du", "dulls"), "positive_window": ("ha", "happy"), "topic_cooling": ("co", "cools")}


def _candidates(trigger: str) -> str:
    source, where = _KINDS[trigger]
    own = source.split()[0]
    return f"select {own}.conversation_id, {own}.id, {own}.ts_sec, {own}.intensity as level, '{trigger}' as trigger, '{triggers.SEVERITIES[trigger]}' as severity, {triggers.PAUSES[trigger]} as pause from {source} where {where}"


#: Each candidate knows the next one beyond its pause; from the first one on these are followed.
_FIRED = f"""ca as (select *, row_number() over (partition by conversation_id, trigger order by ts_sec, id) as k from ({" union all ".join(_candidates(t) for t in _KINDS)})),
nx as (select a.conversation_id, a.trigger, a.k, min(b.k) as next from ca a join ca b on b.conversation_id = a.conversation_id and b.trigger = a.trigger and b.ts_sec >= a.ts_sec + a.pause group by 1, 2, 3),
fi(conversation_id, trigger, k) as (select distinct conversation_id, trigger, 1::bigint from ca union all select nx.conversation_id, nx.trigger, nx.next from fi join nx using (conversation_id, trigger, k))"""


@operator("stm_11", f"""{_PEER}, {_STREAK}, {_SHIFT}, {_DULL}, {_HAPPY}, {_COOL}, {_QUIET}, {_FIRED} select conversation_id, id, ts_sec, trigger, severity, level from ca join fi using (conversation_id, trigger, k)
union all select conversation_id, id, ts_sec, 'silence', 'medium', 0e0 from qu""")
def all_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six triggers with their pauses and severities, as the stream fires them."""
    return triggers.triggers_batch(peers(spark, sf_dir))


#: Messages come in batches by the day; one in so many comes days later.
LATE_EVERY, DAYS_LATE = 97, 2


@operator("stm_13", f"""with {M}, x as (select conversation_id, ts_sec, ts_sec // 86400 + case when id % {LATE_EVERY} = 0 then {DAYS_LATE} else 0 end as batch from m),
g as (select conversation_id, batch, count(*) as n, max(ts_sec) as latest from x group by 1, 2), f as (select *, max(latest) over w as frontier, sum(n) over w as held from g
  window w as (partition by conversation_id order by batch rows between unbounded preceding and 1 preceding))
select f.conversation_id, f.batch, any_value(n) as n, count(*) filter (where x.ts_sec < frontier) as late, any_value(frontier) as frontier_sec, count(*) filter (where x.ts_sec < frontier) > 0 as stale,
  (case when count(*) filter (where x.ts_sec < frontier) > 0 then coalesce(any_value(held), 0) else 0 end + any_value(n))::bigint as read from f join x on x.conversation_id = f.conversation_id and x.batch = f.batch group by f.conversation_id, f.batch""")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch touches: late rows, which keys they make stale, and how many rows a snapshot's renewal reads."""
    batch = F.expr(f"ts_sec div 86400 + if(id % {LATE_EVERY} = 0, {DAYS_LATE}, 0)")
    x = messages(spark, sf_dir).select("conversation_id", "ts_sec", batch.alias("batch"))
    before = Window.partitionBy("conversation_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)  # a row per batch
    g = x.groupBy("conversation_id", "batch").agg(F.count("*").alias("n"), F.max("ts_sec").alias("latest")).withColumns({"frontier_sec": F.max("latest").over(before), "held": F.sum("n").over(before)})
    key = F.struct("conversation_id", "batch").alias("conversation_id")
    found = late.touched(x.select(key, "ts_sec"), g.select(key, "frontier_sec")).select("conversation_id.*", "n", "late", "frontier_sec", "stale")
    read = F.when(F.col("stale"), F.coalesce("held", F.lit(0))).otherwise(0) + F.col("n")
    return found.join(g.select("conversation_id", "batch", "held"), ["conversation_id", "batch"]).withColumn("read", read).drop("held")


declare("stm_14", "The window without notices: the newest twenty messages and five shares of each conversation.", """
with r as (select conversation_id, id, message_type, row_number() over (partition by conversation_id, case when message_type = 43 then 1 else 0 end order by ts desc, id desc) as k from {m} where message_type <> 10000)
select conversation_id, id, message_type from r where (message_type = 43 and k <= 5) or (message_type <> 43 and k <= 20)""")


@operator("stm_15", f"""with {M}, b as (select *, ts_sec - lag(ts_sec) over (partition by conversation_id order by ts, id) as gap from m), r as (select *, sum(case when gap <= 1800 then 0 else 1 end) over (partition by conversation_id order by ts, id) as sid from b)
select conversation_id, min(ts_sec) as start_sec, max(ts_sec) as end_sec, count(*) as n from r group by conversation_id, sid""")
def session_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by Spark's own session windows of half an hour, as a stream would close them."""
    m = messages(spark, sf_dir).withColumn("at", F.timestamp_seconds("ts_sec"))
    w = m.groupBy("conversation_id", F.session_window("at", "30 minutes").alias("w")).agg(F.min("ts_sec").alias("start_sec"), F.max("ts_sec").alias("end_sec"), F.count("*").alias("n"))
    return w.drop("w")


#: How long after a suggestion it is looked at, in turn: before a message may be unrelated, before the window's end, at it, and later.
CHECKED_AFTER = (100, 400, 600, 900)


def offered(spark: SparkSession, sf_dir: str, every: int = 3) -> DataFrame:
    """Suggestions after the peer's messages, one for each ``every`` of them: the content itself and that of the peer's message before."""
    m = timeline.with_day(spoken(spark, sf_dir)).where("is_sender = 0")
    linked = timeline.with_previous(m, ["content"], KEY, ORDER).where(F.col("id") % every == 0)
    after = F.element_at(F.array(*(F.lit(s) for s in CHECKED_AFTER)), ((F.col("id") / every).cast("int") % len(CHECKED_AFTER)) + 1)
    speeches = F.array_compact(F.array("content", "prev_content"))
    return linked.select(F.col("id").alias("suggestion_id"), "conversation_id", (F.col("ts_sec") + 1).alias("created_sec"), (F.col("ts_sec") + 1 + after).alias("now_sec"), speeches.alias("speeches"))


@operator("stm_16")
def attribution_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of suggestions within ten minutes: interrupted, accepted, rewritten, answered after a preface, unrelated, none, or still pending."""
    sender = F.when(F.col("message_type") == 10000, "system").when(F.col("is_sender") == 1, "self").otherwise("friend")
    return attribution.attributions(offered(spark, sf_dir), spoken(spark, sf_dir).withColumn("sender", sender))
