"""Joins: equi, anti, chain, interval, nearest and overlap. Interval joins become windows wherever intervals are disjoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.numbers import dot, rounded
from parley.operators import timeline
from parley.plans.ctes import PAIRS, SESSIONS, UNITS
from parley.registry import declare, operator
from parley.views import M, messages, table

declare("joi_01", "Messages with their sentiment, covered ones only.", """
select m.conversation_id, m.id, c.polarity, c.intensity from {m} m join {c} c on c.message_id = m.id""")

declare("joi_02", "Messages with their sentiment, uncovered ones kept.", """
select m.conversation_id, m.id, c.polarity, c.intensity from {m} m left join {c} c on c.message_id = m.id""")

declare("joi_03", "Messages that lack sentiment.", """
select m.conversation_id, m.id from {m} m left join {c} c on c.message_id = m.id where c.message_id is null""")


@operator("joi_04", f"""with {M}, p as (select *, lag(is_sender) over w as ps, lag(ts_sec) over w as pt from m window w as (partition by conversation_id order by ts, id)),
r as (select id as reply_id, ts_sec - pt as raw from p where ps <> is_sender and ts_sec - pt between 0 and 86400)
select m.conversation_id, m.is_sender, count(*) as replies, cast(sum(raw) as bigint) as seconds from r join m on m.id = r.reply_id where m.ts >= timestamp '2024-01-08 00:00:00' group by 1, 2""")
def replies_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response times joined with the reply for its side and time. Nights count in full."""
    m = messages(spark, sf_dir)
    linked = timeline.with_previous(timeline.with_day(m), ["is_sender", "ts_sec"], ["conversation_id"], ["ts", "id"])
    raw = F.col("ts_sec") - F.col("prev_ts_sec")
    replies = linked.where((F.col("prev_is_sender") != F.col("is_sender")) & raw.between(0, timeline.DAY)).select(F.col("id").alias("reply_id"), raw.alias("raw"))
    joined = m.where("ts >= timestamp_ntz '2024-01-08 00:00:00'").join(replies, F.col("id") == F.col("reply_id"))
    return joined.groupBy("conversation_id", "is_sender").agg(F.count("*").alias("replies"), F.sum("raw").alias("seconds"))


declare("joi_05", "Characters of valid messages by side, through the cleaned texts.", """
with p as (select id as message_id, replace(content, ' ', '') as cleaned, length(content) >= 2 as is_valid from {m})
select m.conversation_id, m.is_sender, count(*) as n, cast(sum(length(p.cleaned)) as bigint) as chars
from {m} m join p on p.message_id = m.id where p.is_valid and m.message_type = 1 group by m.conversation_id, m.is_sender""")

declare("joi_06", "Conversations with their contact by a key of two columns.", """
with k as (select c_custkey as contact, c_nationkey % 2 as account, c_name as name from {customer}),
v as (select distinct conversation_id, conversation_id % 2 as account from {ms})
select v.conversation_id, v.account, k.name from v left join k on k.contact = v.conversation_id and k.account = v.account""")


@operator("joi_07", f"""with {M}, {UNITS}, {PAIRS} select p.conversation_id, p.from_unit, p.to_unit, a.n_chars as from_chars, b.n_chars as to_chars, b.start_sec - a.end_sec as gap_sec
from pairs p join u a on a.conversation_id = p.conversation_id and a.unit_id = p.from_unit join u b on b.conversation_id = p.conversation_id and b.unit_id = p.to_unit""")
def pair_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the columns of both their units. Carried along the scan, so that no unit is joined back."""
    pairs = timeline.interaction_pairs(messages(spark, sf_dir))
    return pairs.select("conversation_id", F.col("prev_unit_id").alias("from_unit"), F.col("unit_id").alias("to_unit"), F.col("prev_n_chars").alias("from_chars"), F.col("n_chars").alias("to_chars"), "gap_sec")


@operator("joi_08", f"""with {M}, {UNITS} select u.conversation_id, u.unit_id, string_agg(m.content, ' | ' order by x.pos) as text
from u, unnest(message_ids) with ordinality as x(id, pos) join m on m.id = x.id where u.n_messages > 1 group by 1, 2""")
def unit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units' texts put together again from their lists of message ids."""
    m = messages(spark, sf_dir)
    ids = timeline.speech_units(m).where("n_messages > 1").select("conversation_id", "unit_id", F.posexplode("message_ids").alias("pos", "id"))
    joined = ids.join(m.select("id", "content"), "id")
    return joined.groupBy("conversation_id", "unit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), " | ").alias("text"))


@operator("joi_09", f"""with {M}, {UNITS}, {SESSIONS} select u.conversation_id, u.unit_id, min(s.session_id) as session_id from u join sess s
on s.conversation_id = u.conversation_id and u.start_sec between s.start_sec and s.end_sec group by 1, 2""")
def session_of_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's session: sessions don't overlap, so the id is carried along the scan instead of a range join."""
    units = timeline.session_ids(timeline.speech_units(messages(spark, sf_dir)), start="ts", end="end_ts", order=("ts", "unit_id"))
    return units.select("conversation_id", "unit_id", "session_id")


@operator("joi_10", f"""with {M}, {UNITS}, {SESSIONS}, n as (select *, lead(start_sec) over (partition by conversation_id order by start_sec) as next from sess)
select m.conversation_id, m.id, n.session_id from m join n on n.conversation_id = m.conversation_id and m.ts_sec >= n.start_sec and (m.ts_sec < n.next or n.next is null)""")
def session_of_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message's session, by way of its unit."""
    units = timeline.session_ids(timeline.speech_units(messages(spark, sf_dir)), start="ts", end="end_ts", order=("ts", "unit_id"))
    return units.select("conversation_id", F.explode("message_ids").alias("id"), "session_id")


@operator("joi_11", f"""with {M} select a.conversation_id, a.id, max(b.ts_sec) as peer_ts from m a join m b on b.conversation_id = a.conversation_id and b.is_sender = 0
and a.is_sender = 1 and (b.ts, b.id) < (a.ts, a.id) and a.ts_sec - b.ts_sec <= 1800 group by 1, 2""")
def nearest_peer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For own messages the time of the last one of the peer, if it is at most half an hour ago."""
    window = Window.partitionBy("conversation_id", "cell").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    m = messages(spark, sf_dir)
    # a cell of half an hour also gets the messages of the cell before, so that no window spans a conversation
    spread = m.select("*", F.explode(F.expr("array(ts_sec div 1800, ts_sec div 1800 + 1)")).alias("cell"))
    seen = spread.withColumn("peer_ts", F.max(F.when(F.col("is_sender") == 0, F.col("ts_sec"))).over(window))
    return seen.where("is_sender = 1 and cell = ts_sec div 1800 and ts_sec - peer_ts <= 1800").select("conversation_id", "id", "peer_ts")


@operator("joi_12", f"""with {M}, {UNITS}, {SESSIONS} select conversation_id, session_id, start_sec from sess
where start_sec between cast(epoch(timestamp '2024-01-10 12:00:00') as bigint) - 120 and cast(epoch(timestamp '2024-01-10 12:00:00') as bigint) + 120 or session_id = 1""")
def sessions_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that begin within two minutes of a moment, and each conversation's first."""
    at = F.unix_timestamp(F.to_timestamp_ntz(F.lit("2024-01-10 12:00:00")))
    return timeline.sessions(messages(spark, sf_dir)).where(F.col("start_sec").between(at - 120, at + 120) | (F.col("session_id") == 1)).select("conversation_id", "session_id", "start_sec")


@operator("joi_13", f"""with {M}, {UNITS}, {SESSIONS} select a.conversation_id, a.session_id, (select max(b.end_sec) from sess b where b.conversation_id = a.conversation_id and b.end_sec < a.start_sec) as previous_end
from sess a""")
def previous_session_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of the session before: a correlated subquery with an inequality, as a carried value."""
    s = timeline.sessions(messages(spark, sf_dir)).withColumn("day", F.to_date("start_ts"))
    return timeline.with_previous(s, ["end_sec"], ["conversation_id"], ["session_id"]).select("conversation_id", "session_id", F.col("prev_end_sec").alias("previous_end"))


declare("joi_14", "Week boundaries (as day numbers) snapped to the nearest milestone within seven days, the earlier of equals.", """
with b as (select distinct conversation_id, ts_sec {div} 86400 - mod(ts_sec {div} 86400 + 3, 7) as boundary from {m}),
k as (select conversation_id, ts_sec {div} 86400 as mark from {m} where id % 700 = 0),
r as (select b.conversation_id, b.boundary, k.mark, row_number() over (partition by b.conversation_id, b.boundary order by abs(k.mark - b.boundary), k.mark) as n
  from b left join k on k.conversation_id = b.conversation_id and k.mark between b.boundary - 7 and b.boundary + 7)
select conversation_id, boundary, coalesce(mark, boundary) as snapped from r where n = 1""")

declare("joi_15", "Documents with their vectors where label and id agree, those without kept.", """
select d.doc_id, v.label, v.vec_id is not null as embedded from {documents} d left join {embeddings} v on v.vec_id = d.doc_id and v.label % 2 = d.doc_id % 2""")

declare("joi_16", "Buffered live messages with realtime sentiment by content hash.", """
with b as (select id, sha1(concat(cast(conversation_id as varchar(20)), '|', content)) as hash from {m}),
r as (select sha1(concat(cast(conversation_id as varchar(20)), '|', content)) as hash, max(id) as scored from {m} where id % 3 <> 0 group by 1)
select b.id, b.hash, r.scored from b left join r on r.hash = b.hash""".replace("sha1(", "md5("))


@operator("joi_17", """with q as (select embedding as qv from embeddings where vec_id = 7) select vec_id, round(list_dot_product(list_transform(embedding, lambda x: cast(x as double)), list_transform(qv, lambda x: cast(x as double))) + 1e-9, 4) as score from embeddings, q""")
def scored_against(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors scored against one query vector, which travels as a literal."""
    v = table(spark, sf_dir, "embeddings")
    query = v.where("vec_id = 7").select("embedding").first()
    vector = F.array(*(F.lit(float(x)) for x in (query[0] if query else [])))
    return v.select("vec_id", rounded(dot(F.col("embedding"), vector)).alias("score"))


declare("joi_18", "Months and chapters of two weeks that overlap.", """
with mo as (select conversation_id, date_trunc('month', ts) as month, min(ts_sec) as first_sec, max(ts_sec) as last_sec from {m} group by 1, 2),
ch as (select conversation_id, ts_sec {div} 1209600 as chapter, min(ts_sec) as first_sec, max(ts_sec) as last_sec from {m} group by 1, 2)
select mo.conversation_id, mo.month, ch.chapter from mo join ch on ch.conversation_id = mo.conversation_id and mo.first_sec <= ch.last_sec and mo.last_sec >= ch.first_sec""")


@operator("joi_19", f"""with {M}, {UNITS}, {PAIRS}, {SESSIONS}, chosen as (select * from sess where unit_count >= 2)
select s.conversation_id, s.session_id, count(*) as pairs, round(avg(least(p.from_chars, p.to_chars) * 1.0 / greatest(p.from_chars, p.to_chars)) + 1e-9, 4) as likeness
from pairs p join u on u.conversation_id = p.conversation_id and u.unit_id = p.from_unit join chosen s on s.conversation_id = u.conversation_id and u.start_sec between s.start_sec and s.end_sec group by 1, 2""")
def pairs_in_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean likeness of pairs whose first unit lies in a session of two units or more."""
    m = messages(spark, sf_dir)
    units = timeline.session_ids(timeline.speech_units(m), start="ts", end="end_ts", order=("ts", "unit_id"))
    chosen = units.groupBy("conversation_id", "session_id").agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    of_unit = units.select("conversation_id", F.col("unit_id").alias("prev_unit_id"), "session_id").join(chosen, ["conversation_id", "session_id"])
    pairs = timeline.interaction_pairs(m).join(of_unit, ["conversation_id", "prev_unit_id"])
    likeness = F.least("prev_n_chars", "n_chars") / F.greatest("prev_n_chars", "n_chars")
    return pairs.groupBy("conversation_id", "session_id").agg(F.count("*").alias("pairs"), rounded(F.avg(likeness)).alias("likeness"))


