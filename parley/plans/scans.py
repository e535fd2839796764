"""Scans, filters, ingestion rules and projections over message timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.registry import declare, operator
from parley.sources import ingest
from parley.views import M, messages

declare("src_01", "Messages of one conversation between two positions, by time.", """
select conversation_id, id, ts, is_sender, content from {m} where conversation_id = 0 order by ts, id limit 50 offset 20""")

declare("src_02", "Non-blank texts in a closed window of time.", """
select conversation_id, id, ts_sec, is_sender, content from {m}
where message_type = 1 and content is not null and trim(content) <> '' and ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-12 00:00:00'""")

declare("src_03", "Texts with their sentiment, uncovered ones kept.", """
select m.conversation_id, m.id, m.ts_sec, c.polarity, c.intensity from {m} m left join {c} c on c.message_id = m.id where m.message_type = 1""")

declare("src_04", "The newest 200 visible messages over all shards, in ascending order.", """
select * from (select id, conversation_id, ts_sec, content from (
  select id, conversation_id, ts_sec, content from {m} where conversation_id % 2 = 0
  union all select id, conversation_id, ts_sec, content from {m} where conversation_id % 2 = 1) shards order by ts_sec desc, id desc limit 200) newest order by ts_sec, id""")

declare("src_05", "Messages of all shards with their sender's name where one is known.", """
select m.id, m.conversation_id, coalesce(k.c_name, concat('member ', cast(m.member as varchar(20)))) as sender
from {m} m left join {customer} k on k.c_custkey = m.member and k.c_acctbal >= 0""")


@operator("src_06", f"""with {M}, w as (select conversation_id, max(ts_sec) - 5 * 86400 as watermark from m group by 1)
select m.conversation_id, m.id, m.ts_sec from m join w using (conversation_id) where m.ts_sec between watermark - 86400 and watermark + 86400""")
def since_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages within a day around each conversation's watermark, here five days before its end."""
    m = messages(spark, sf_dir)
    marks = m.groupBy("conversation_id").agg((F.max("ts_sec") - 5 * 86400).alias("watermark"))
    return ingest.since_watermark(m, marks).select("conversation_id", "id", "ts_sec")


@operator("src_07", f"""with {M}, old as (select conversation_id, id, ts_sec from m where id % 3 = 0),
batch as (select * from m union all select * from m where id % 5 = 0),
new as (select distinct on (conversation_id, id, ts_sec) conversation_id, id, ts_sec, content from batch)
select n.* from new n where not exists (select 1 from old o where o.conversation_id = n.conversation_id and o.id = n.id and o.ts_sec = n.ts_sec)""")
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import adds: rows of a batch (which repeats some) whose key is not there yet."""
    m = messages(spark, sf_dir)
    batch = m.union(m.where("id % 5 = 0")).select("conversation_id", "id", "ts_sec", "content")
    return ingest.new_rows(batch, m.where("id % 3 = 0"), ["conversation_id", "id", "ts_sec"])


@operator("src_08")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live captures matched with imported messages, one to one, nearest first, within 59 seconds."""
    m = messages(spark, sf_dir)
    live = m.where("id % 2 = 0").select(F.col("id").alias("live_id"), "conversation_id", "is_sender", "message_type", "content", (F.col("ts_sec") + F.col("id") % 90).alias("ts_sec"))
    return ingest.reconcile(m, live, ["conversation_id", "is_sender", "message_type", "content"])


@operator("src_09", f"""with {M} select id, message_type, case when id % 7 <> 3 then content when message_type = 43 then '[video]' when message_type = 47 then '[sticker]' else '[binary]' end as content from m""")
def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored contents (text, compressed or binary) as text, or a placeholder by message type; every seventh is binary."""
    m = messages(spark, sf_dir)
    raw = F.when(F.col("id") % 7 == 3, F.unhex(F.lit("FFFE00C3"))).otherwise(F.encode("content", "utf-8"))
    return ingest.decode_content(m.select("id", "message_type", raw.alias("raw")))


declare("src_10", "Group messages split into sender and body where the prefix names a member.", r"""
with g as (select id, concat('user', cast(member as varchar(20)), ': ', content) as raw from {m}),
p as (select id, raw, regexp_extract(raw, '^([a-z]+[0-9]+): ?', 1) as prefix from g),
roster as (select concat('user', cast(c_custkey as varchar(20))) as member from {customer} where c_nationkey < 20)
select p.id, roster.member as sender, case when roster.member is null then raw else regexp_replace(raw, '^([a-z]+[0-9]+): ?', '') end as body
from p left join roster on roster.member = p.prefix""")

declare("src_11", "Accounts that take part: not listed, without an excluded part or prefix.", """
select c_custkey, c_name from {customer}
where c_name not in ('Customer#000000001', 'Customer#000000002') and c_name not like '%0013%' and c_name not like 'Customer#00000014%'""")

declare("src_12", "Contacts after an upsert that keeps known values where the new ones are missing.", """
with fresh as (select c_custkey, case when c_custkey % 3 = 0 then null else concat(c_name, '+') end as name, c_mktsegment as segment from {customer} where c_custkey % 2 = 0),
known as (select c_custkey, c_name as name, c_mktsegment as segment from {customer} where c_custkey % 5 <> 0)
select coalesce(f.c_custkey, k.c_custkey) as contact_id, coalesce(f.name, k.name) as name, coalesce(f.segment, k.segment) as segment
from known k full outer join fresh f on f.c_custkey = k.c_custkey""")

declare("src_13", "Counters of each conversation: messages and the last time.", """
select conversation_id, count(*) as message_count, max(ts_sec) as last_ts from {m} group by conversation_id""")

declare("src_14", "Conversations (customers) that have a contact (an order) to take metadata from.", """
select c_custkey, c_name from {customer} c where exists (select 1 from {orders} o where o.o_custkey = c.c_custkey and o.o_totalprice > 200000)""")

declare("src_15", "Accounts with a mark on those that are excluded.", """
select c_custkey, case when c_mktsegment = 'MACHINERY' or c_acctbal < 0 then true else false end as deleted from {customer}""")

declare("src_16", "Totals of an import.", """
select count(*) as messages, count(distinct conversation_id) as conversations, count(distinct member) as contacts, min(ts_sec) as first_ts, max(ts_sec) as last_ts from {m}""")

declare("prj_01", "Display names with fallbacks, the most recent conversation first.", """
with last as (select conversation_id, max(ts_sec) as last_ts from {m} group by conversation_id)
select conversation_id, coalesce(nullif(trim(case when c_custkey % 4 = 0 then '  ' else c_name end), ''), nullif(trim(c_mktsegment), ''), 'unknown') as name, last_ts
from last left join {customer} on c_custkey = conversation_id order by last_ts desc, conversation_id""")

declare("prj_02", "Messages that wait for analysis; null where none was ever made.", """
with n as (select conversation_id, count(*) as total, count(case when id % 10 < 7 then 1 end) as done from {m} group by conversation_id)
select conversation_id, case when conversation_id % 3 = 2 then null else greatest(0, total - done) end as pending from n""")

declare("prj_03", "Texts that are not blank.", """
select id, conversation_id from {m} where message_type = 1 and content is not null and trim(content) <> ''""")

declare("prj_04", "Five ways to say night.", """
select id, hour(ts) < 5 as till_four, hour(ts) >= 23 or hour(ts) < 5 as from_eleven, hour(ts) < 6 as before_six, hour(ts) >= 2 and hour(ts) < 6 as deep, hour(ts) < 7 as asleep from {m}""")

declare("prj_05", "Texts that hold a part, whatever the case of its letters; an escaped wildcard is a plain character.", """
select id, conversation_id from {m} where content ilike '%SIGNUP%' or lower(content) like '%"k": 7%' or content ilike '%100!%%' escape '!'""")

declare("prj_06", "Messages that share something: cards, videos, or texts with a link.", """
select id, conversation_id from {m} where message_type in (3, 43) or (message_type = 1 and lower(content) like '%http%')""")

declare("prj_07", "Turns that ask, by either question mark; every third one ends with one here, and every seventh with the wide one.", """
select conv_id, turn, text from (select conv_id, turn, concat(text, case when (conv_id + turn) % 3 = 0 then '?' when (conv_id + turn) % 7 = 0 then '？' else '' end) as text from {d}) as t where text like '%?%' or text like '%？%'""")

declare("prj_08", "Kinds of messages: system first, then transfers, then those without content, else chat.", """
select id, case when message_type = 10000 then 'system' when message_type = 43 and content like '%1%' then 'transfer'
  when content is null or trim(content) = '' then 'unparseable' else 'chat' end as kind from {m}""")

declare("prj_09", "A page of conversations, newest first.", """
select conversation_id, max(ts_sec) as last_ts, count(*) as n from {ms} group by conversation_id order by last_ts desc, conversation_id limit 20 offset 20""")

declare("prj_10", "Conversations whose analysis is stale: more messages, or later ones, than it has seen.", """
with now as (select conversation_id, count(*) as n, max(ts_sec) as last_ts from {ms} group by conversation_id),
seen as (select conversation_id, count(*) as n, max(ts_sec) as last_ts from {ms} where ts < timestamp '2024-01-29 12:00:00' group by conversation_id)
select now.conversation_id, now.n, coalesce(seen.n, 0) as analysed, seen.n is null or now.n > seen.n or now.last_ts > seen.last_ts as stale
from now left join seen on seen.conversation_id = now.conversation_id""")


@operator("snk_01", f"""with {M}, l as (select *, lag(cast(ts as date)) over (partition by conversation_id order by ts, id) as before from m)
select conversation_id, id, case when before is null or before <> cast(ts as date) then '--- ' || strftime(ts, '%Y-%m-%d') || ' ---' || chr(10) else '' end
  || strftime(ts, '%H:%M:%S') || ' ' || case when is_sender = 1 then 'me' else 'member ' || member end || ': ' || content as line from l""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a text export, a separator wherever the day changes."""
    from parley.sources.export import text_lines as lines

    return lines(messages(spark, sf_dir))


declare("snk_02", "The rows of a CSV export, with names for message types.", """
select conversation_id, id, ts_sec, case when is_sender = 1 then 'me' else 'other' end as side,
  case message_type when 1 then 'text' when 43 then 'video' when 47 then 'sticker' else 'system' end as kind, content from {m}""")

_HTML = "replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@operator("snk_03", f"""with {M}, f as (select conversation_id, member, min((ts_sec, id)) as first from m group by 1, 2),
k as (select conversation_id, member, row_number() over (partition by conversation_id order by first) - 1 as colour from f)
select conversation_id, id, '<p class="' || case when is_sender = 1 then 'me' else 'c' || (colour % 8) end || '">' || {_HTML} || '</p>' as html from m join k using (conversation_id, member)""")
def bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of an HTML export, coloured by the order in which members first appear."""
    from parley.sources.export import html_bubbles

    return html_bubbles(messages(spark, sf_dir))


@operator("snk_06")
def corpus_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """A seeded message table, the same at every run."""
    return ingest.synthetic_messages(spark, conversations=8, each=500)

