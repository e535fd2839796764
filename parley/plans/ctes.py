"""DuckDB common table expressions of units, pairs and sessions, over whole conversations: the counterpart of ``timeline``."""

from __future__ import annotations

from parley.functions.lexicon import Words

#: Over ``m``.
UNITS = """ub as (select *, lag(is_sender) over w as ps, lag(ts_sec) over w as pt from m window w as (partition by conversation_id order by ts, id)),
ur as (select *, sum(case when ps = is_sender and ts_sec - pt < 300 then 0 else 1 end) over (partition by conversation_id order by ts, id) as run from ub),
u as (select conversation_id, cast(run as bigint) as unit_id, min(is_sender) as is_sender, min(ts) as ts, min(ts_sec) as start_sec, max(ts) as end_ts, max(ts_sec) as end_sec, count(*) as n_messages,
  cast(sum(length(content)) as bigint) as n_chars, list(id order by ts, id) as message_ids from ur group by 1, 2)"""

#: Over ``u``.
PAIRS = """pairs as (select * from (select conversation_id, lag(unit_id) over w as from_unit, unit_id as to_unit, lag(is_sender) over w as from_side, is_sender as to_side,
  lag(n_chars) over w as from_chars, n_chars as to_chars, start_sec - lag(end_sec) over w as gap_sec from u window w as (partition by conversation_id order by unit_id)) where from_side <> to_side)"""

SESSIONS = """sb as (select *, lag(end_ts) over w as pe, lag(end_sec) over w as ps2 from u window w as (partition by conversation_id order by unit_id)),
sr as (select *, sum(case when pe is null or start_sec - ps2 > 1800 or cast(pe as date) <> cast(ts as date) or (hour(pe) < 7 and hour(ts) >= 7) then 1 else 0 end)
  over (partition by conversation_id order by unit_id) as sid from sb),
sess as (select conversation_id, cast(sid as bigint) as session_id, min(ts) as start_ts, max(end_ts) as end_ts, min(start_sec) as start_sec, max(end_sec) as end_sec,
  count(*) as unit_count, cast(sum(n_messages) as bigint) as message_count, min_by(is_sender, unit_id) as initiator from sr group by 1, 2)"""

#: Over ``m``: both directions of replies, nights taken off where slept through.
REPLIES = """rb as (select *, lag(is_sender) over w as ps, lag(ts_sec) over w as pt, lag(ts) over w as pts, lag(id) over w as pid from m window w as (partition by conversation_id order by ts, id)),
rt as (select *, ts_sec - pt as raw, case when cast(pts as date) <> cast(ts as date) or (hour(pts) < 7 and hour(ts) >= 7) then
  greatest(0, least(ts_sec, pt - pt % 86400 + 25200) - pt) + greatest(0, least(ts_sec, pt - pt % 86400 + 111600) - greatest(pt, pt - pt % 86400 + 86400)) else 0 end as slept from rb where ps <> is_sender),
replies as (select conversation_id, pid as sent_id, id as reply_id, ts, case when ps = 1 then 'me_to_other' else 'other_to_me' end as direction, raw < 0 or raw > 86400 as abnormal,
  case when raw between 0 and 86400 then greatest(0, raw - slept) end as response_sec from rt)"""

#: Words that the texts of ``m`` do hold, in place of a chat's.
WORDS = Words(morning=("view",), morning_exact=(), night=("click",), together="[79]", alone="[358]", perfunctory=('click {"k": 4}', 'view {"k": 2}'), engaged=('view {"k": 2}',), greeting_chars=14)
RECALL, OWN = '"k": ([0-9])', ("1", "3", "5", "7", "9")

#: Over ``m``: engagement by its definition, over whole conversations.
ENGAGED = """tx as (select *, trim(content) as c from m where message_type = 1 and trim(content) <> ''),
tp as (select *, lag(is_sender) over w as ps, lag(ts_sec) over w as a, ts_sec as b from tx window w as (partition by conversation_id order by ts, id)),
tr as (select *, sum(case when ps = is_sender then 0 else 1 end) over (partition by conversation_id order by ts, id) as run,
  len(list_filter(generate_series(a // 3600, b // 3600), lambda x: x * 3600 > a and x * 3600 < b and x % 24 between 2 and 6)) > 0 as deep from tp),
tb as (select conversation_id, is_sender, count(*) as bursts from (select conversation_id, is_sender, run from tr group by 1, 2, 3 having count(*) >= 3) group by 1, 2),
td as (select conversation_id, cast(ts as date) as day, count(*) as n from tx group by 1, 2),
tv as (select conversation_id, count(*) as days, case when count(*) >= 2 then round(stddev_pop(n) / avg(n), 4) end as variation from td group by 1),
ts as (select conversation_id, is_sender, count(*) as texts, count(*) filter (where ps <> is_sender and b - a > 86400) as ice_breaks, count(*) filter (where ps <> is_sender and b - a > 7200 and b - a <= 86400 and not deep) as long_unanswered,
  count(distinct cast(ts as date)) filter (where starts_with(c, 'view') and length(c) <= 14) as mornings, count(distinct cast(ts as date)) filter (where starts_with(c, 'click') and length(c) <= 14) as nights,
  sum(len(regexp_extract_all(c, '[79]'))) as we, sum(len(regexp_extract_all(c, '[358]'))) as i, count(*) filter (where c = 'click {"k": 4}' or length(c) <= 2) as dull from tr group by 1, 2),
eng as (select conversation_id, cast(sum(texts) as bigint) as n_texts, any_value(days) as days, any_value(variation) as variation, """ + ", ".join(
    f"""cast(coalesce(sum({c}) filter (where is_sender = {side}), 0) as bigint) as {c}_{name}""" for side, name in ((1, "self"), (0, "other")) for c in ("texts", "bursts", "long_unanswered", "ice_breaks", "mornings", "nights")
) + ", " + ", ".join(
    f"""round(max(we * 1e0 / nullif(we + i, 0)) filter (where is_sender = {side}), 4) as togetherness_{name}, coalesce(max(dull * 1e0 / texts) filter (where is_sender = {side}), 0) as perfunctory_{name}""" for side, name in ((1, "self"), (0, "other"))
) + """ from ts left join tb using (conversation_id, is_sender) join tv using (conversation_id) group by 1)"""
