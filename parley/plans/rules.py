"""Rule classifiers, validators and other small operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import intents, redaction
from parley.functions.lexicon import Cues
from parley.functions.numbers import rounded
from parley.functions.text import bound, character_grams, cleaned
from parley.operators import facts, timeline
from parley.plans.texts import PII_SQL
from parley.registry import declare, operator
from parley.views import S, M, messages, sentiment, table

#: What declines, loses patience and moves a talk on, in the words that events are made of.
EVENT_CUES = Cues(
    questions=("?",), plans=("sign",), details=(": 9",), nonverbal=(), acknowledgements=("view",), strong_acknowledgements=("view",), decline_at_an_end=("error",), decline_within=(),
    decline_around=None, decline_unless=None, impatience=(":1",),
)
_HEARD = "(select id, trim(content) as t, replace(trim(content), ' ', '') as c from m)"


@operator("rul_01", f"with {M} select id, case when starts_with(c, 'error') or ends_with(c, 'error') then 'decline' when contains(c, ':1') then 'impatience' else 'none' end as intent from {_HEARD}")
def intents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a message does by its cues: declines, or loses patience."""
    return messages(spark, sf_dir).select("id", F.coalesce(intents.interaction_intent(F.col("content"), EVENT_CUES), F.lit("none")).alias("intent"))


@operator("rul_02", f"""with {M} select id, contains(t, '?') or contains(t, 'sign') or contains(t, ': 9') or ((regexp_matches(t, '[0-9]') or len(regexp_extract_all(t, '[A-Za-z]')) >= 2) and length(c) >= 40)
  or length(c) >= 40 or (length(c) >= 14 and regexp_matches(t, '[,.!;]')) as substantive from (select id, trim(content) || case when id % 5 = 0 then ', again' else '' end as t, replace(t, ' ', '') as c from m)""")
def substance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a message moves a talk on: long, a question, a plan, or details."""
    content = F.concat(F.trim("content"), F.when(F.col("id") % 5 == 0, ", again").otherwise(""))
    return messages(spark, sf_dir).select("id", intents.substantive(content, EVENT_CUES, 40, 14, 40).alias("substantive"))


@operator("rul_03", f"""with {M}, {S}, r as (select m.conversation_id, m.id, avg(s.intensity) over w as level, min(s.polarity) over w as least, count(*) over w as n from m join s on s.message_id = m.id where m.is_sender = 0
  window w as (partition by m.conversation_id, cast(m.ts as date) order by m.ts, m.id rows between 4 preceding and current row))
select conversation_id, id, n, round(level + 1e-9, 4) as level, case when n < 3 then 'too early' when level > 0.3 then 'warm' when least = -1 and level < -0.3 then 'tense' else 'even' end as insight from r""")
def emotion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peer's last five messages of the day in a word."""
    w = Window.partitionBy("conversation_id", "day").orderBy("ts", "id").rowsBetween(-4, 0)
    m = timeline.with_day(messages(spark, sf_dir).where("is_sender = 0")).join(sentiment(spark, sf_dir), F.col("id") == F.col("message_id"))
    r = m.withColumns({"level": F.avg("intensity").over(w), "least": F.min("polarity").over(w), "n": F.count("*").over(w)})
    insight = F.when(F.col("n") < 3, "too early").when(F.col("level") > 0.3, "warm").when((F.col("least") == -1) & (F.col("level") < -0.3), "tense").otherwise("even")
    return r.select("conversation_id", "id", "n", rounded(F.col("level")).alias("level"), insight.alias("insight"))


declare("rul_04", "What a turn asks memory for.", """
select conv_id, turn, case when lower(text) like '%last time%' or lower(text) like '%avant%' then 'history' when lower(text) like '%we %' then 'relationship' when turn > 0 and length(text) < 60 then 'follow-up' else 'topic' end as intent from {conversations}""")

declare("rul_05", "The task of a message: the first fitting row of a rule table.", """
with rules as (select 1 as place, 'error%' as pattern, 'repair' as task union all select 2, 'sign%', 'welcome' union all select 3, '%: 7%', 'reward' union all select 4, '%', 'reply'),
f as (select m.id, min(r.place) as place from {m} m join rules r on m.content like r.pattern group by 1)
select f.id, r.task from f join rules r on r.place = f.place""")

declare("rul_06", "The trigger that wins among those that fire, by priority and mode.", """
with t as (select m.id, case when s.intensity < -0.8 then 1 when s.polarity = -1 and m.message_type = 10000 then 2 when s.intensity > 0.8 then 3 end as fired from {m} m join {s} s on s.message_id = m.id)
select id, case fired when 1 then 'negative' when 2 then 'notice' when 3 then 'positive' end as resolved, id % 2 = 0 as manual from t where fired is not null""")

declare("rul_07", "Why a fact is not kept, else null.", """
select doc_id, case when text is null or trim(text) = '' then 'empty' when length(text) < 40 then 'short' when length(text) > 20000 then 'long' when lower(text) like '%token =%' then 'secret' when text like '%!!%' then 'noise' end as reason from {documents}""")

declare("rul_08", "Kinds of facts in their normal form, unknown ones left out.", """
with k as (select event_id, case event_type when 'click' then 'interest' when 'view' then 'interest' when 'purchase' then 'habit' when 'signup' then 'event' end as kind from {events}) select event_id, kind from k where kind is not null""")

declare("rul_09", "Fact candidates: marked messages, at most eight per day.", """
with r as (select conversation_id, cast(ts as date) as day, id, row_number() over (partition by conversation_id, cast(ts as date) order by ts, id) as k from {m} where content like '%: 7%' or content like 'sign%') select conversation_id, day, id, k from r where k <= 8""")

declare("rul_10", "Topics of each day: its three most frequent kinds of content, with a message as evidence.", """
with n as (select conversation_id, cast(ts as date) as day, content, count(*) as n, min(id) as evidence from {m} group by 1, 2, 3),
r as (select *, row_number() over (partition by conversation_id, day order by n desc, content) as k from n) select conversation_id, day, content, n, evidence, k from r where k <= 3""")


#: Words of a turn that stand for a window.
WINDOW_WORDS = 40
_RUN = "coalesce(nullif(list_position(list_transform(range(1, 41), lambda k: i + k - 1 <= len(a) and j + k - 1 <= len(b) and a[i + k - 1] = b[j + k - 1]), false), 0) - 1, 40)"


@operator("rul_11", rf"""with w as (select conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '')[1:{WINDOW_WORDS}] as a, lead(list_filter(string_split(text, ' '), lambda x: x <> '')[1:{WINDOW_WORDS}]) over (partition by conv_id order by turn) as b from conversations),
k as (select *, unnest(range(1, greatest(len(a), 1) + 1)) as i from w where b is not null), x as (select *, unnest(range(1, greatest(len(b), 1) + 1)) as j from k),
r as (select conv_id, turn, a, b, i, j, {_RUN} as n from x), s as (select *, n * (len(a) - i + 1) - n * (n - 1) // 2 as weight from r),
t as (select conv_id, turn, any_value(a) as a, arg_max([n, weight, i, j], (n, weight, -i, -j)) as best from s group by 1, 2)
select conv_id, turn, best[1]::bigint as count, best[2]::bigint as weight, case when best[1] > 0 then best[3] - 1 else -1 end as expected_start, case when best[1] > 0 then best[4] - 1 else -1 end as actual_start,
  round(case when len(a) > 0 then best[1] * 1e0 / len(a) else 0 end + 1e-9, 4) as coverage, round(case when len(a) > 0 then best[2] * 2e0 / (len(a) * (len(a) + 1)) else 0 end + 1e-9, 4) as weight_ratio from t""")
def window_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of words that the beginnings of two neighbouring turns have in common, wherever it lies in either."""
    words = F.slice(F.filter(F.split("text", " "), lambda x: x != ""), 1, WINDOW_WORDS)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("expected")).withColumn("actual", F.lead("expected").over(Window.partitionBy("conv_id").orderBy("turn"))).where("actual is not null")
    found = facts.best_overlap(turns.select(F.struct("conv_id", "turn").alias("key"), "expected", "actual"))
    return found.select("key.conv_id", "key.turn", "count", "weight", "expected_start", "actual_start", rounded(F.col("coverage")).alias("coverage"), rounded(F.col("weight_ratio")).alias("weight_ratio"))


declare("rul_12", "Members' scores from some of the indicators.", """
select conversation_id, member, count(*) as n, round(60 * avg(case when length(content) > 14 then 1e0 else 0e0 end) + 40 * avg(case when hour(ts) between 8 and 22 then 1e0 else 0e0 end) + 1e-9, 4) as score from {m} group by 1, 2""")

declare("rul_13", "Adjustments within bounds, where their evidence is in the text.", """
select m.id, round(case when m.content like '%click%' then greatest(-10e0, least(10e0, s.intensity * 15)) else 0e0 end + 1e-9, 4) as adjustment from {m} m join {s} s on s.message_id = m.id""")

declare("rul_14", "Quotes that are in the text they are said to be from.", """
with q as (select conv_id, turn, case when turn % 2 = 0 then substring(text, 5, 30) else concat('x', substring(text, 5, 30), '#') end as quote from {conversations})
select q.conv_id, q.turn from q join {conversations} c on c.conv_id = q.conv_id and c.turn = q.turn where c.text like '%' and replace(c.text, q.quote, '') <> c.text""")

declare("rul_15", "Signals per thousand messages.", """
select conversation_id, round(1000 * avg(case when content like 'error%' then 1e0 else 0e0 end) + 1e-9, 4) as errors, round(1000 * avg(case when content like '%: 7%' then 1e0 else 0e0 end) + 1e-9, 4) as marks from {m} group by 1""")

declare("rul_16", "Thresholds by kind of relation, from a small table of parameters.", """
with p as (select 'AUTOMOBILE' as segment, 0.1e0 as threshold union all select 'BUILDING', 0.2e0 union all select 'MACHINERY', 0.3e0)
select c.c_custkey, coalesce(p.threshold, 0.25e0) as threshold from {customer} c left join p on p.segment = c.c_mktsegment""")

declare("rul_17", "Parameters out of their range.", """
with p as (select 'merge_gap' as name, 300 as value, 30 as low, 3600 as high union all select 'session_gap', 1800, 300, 86400 union all select 'weight_sum', 108, 100, 100) select name, value from p where value < low or value > high""")


@operator("rul_18", """with k as (select conv_id, turn, lower(text) as a, lower(regexp_replace(text, '[0-9éèê]', '', 'g')) as b from conversations),
g as (select conv_id, turn, list_distinct(list_transform(range(1, length(a)), lambda i: substring(a, i, 2))) as ga, list_distinct(list_transform(range(1, length(b)), lambda i: substring(b, i, 2))) as gb from k)
select conv_id, turn, len(list_intersect(ga, gb)) as shared, len(list_intersect(ga, gb)) * 2 >= len(ga) as keeps_core from g""")
def redaction_keeps_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a redacted text keeps half of its character pairs; null for a null."""
    a, b = F.lower("text"), F.lower(F.regexp_replace("text", "[0-9éèê]", ""))
    grams = F.struct(*(F.array_distinct(character_grams(x, 2)).alias(name) for name, x in (("a", a), ("b", b))))
    sizes = bound(grams, lambda g: F.struct(F.size(F.array_intersect(g["a"], g["b"])).alias("shared"), F.size(g["a"]).alias("n")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("text").isNotNull(), sizes).alias("k")).select("conv_id", "turn", "k.shared", (F.col("k.shared") * 2 >= F.col("k.n")).alias("keeps_core"))


@operator("rul_19", "select conv_id, turn, not (" + " or ".join(f"coalesce(regexp_matches(text, '{p}'), false)" for p in PII_SQL.values()) + ") as safe from conversations")
def safe_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole phrases that are safe to show: the detector of personal data finds nothing in them."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.size(redaction.entities(F.col("text"))) == 0).alias("safe"))


declare("rul_20", "A log in which an event of a kind occurs once per user and day, the first one.", """
select user_id, event_type, cast(ts as date) as day, min(event_id) as event_id from {events} group by 1, 2, 3""")

declare("rul_21", "What is left after a retention of fourteen days.", """
select event_id from {events} where ts >= timestamp '2024-01-16 00:00:00'""")

declare("rul_22", "Facts that their user has disabled: the latest feedback decides, unless it restores.", """
with f as (select user_id, event_type as action, row_number() over (partition by user_id order by ts desc, event_id desc) as k from {events} where event_type in ('error', 'signup', 'view'))
select user_id, action, action <> 'signup' as disabled from f where k = 1""")


@operator("rul_23", r"""with c as (select trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)<msg>.*?</msg>', ' ', 'g'), '\[(image|voice|video|sticker|file)\]', ' ', 'g'), '\s+', ' ', 'g')) as t from conversations)
select count(*) as total, count(*) filter (where length(t) >= 2) as valid, round(avg(length(t)) filter (where length(t) >= 2) + 1e-9, 4) as mean_chars, round(avg(len(string_split(t, ' '))) filter (where length(t) >= 2) + 1e-9, 4) as mean_words from c""")
def cleaning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a cleaning pass."""
    c = table(spark, sf_dir, "conversations").select(cleaned(F.col("text")).alias("t"))
    valid = F.length("t") >= 2
    return c.agg(F.count("*").alias("total"), F.count_if(valid).alias("valid"), rounded(F.avg(F.when(valid, F.length("t")))).alias("mean_chars"), rounded(F.avg(F.when(valid, F.size(F.split("t", " "))))).alias("mean_words"))


declare("rul_24", "Messages without repeated captures: one per member, content and minute.", """
select conversation_id, member, content, ts_sec {div} 60 as minute, min(id) as id, count(*) as captures from {m} group by 1, 2, 3, 4""")

