"""Retrieval, change points and text mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.numbers import dot, rounded
from parley.functions.text import tokens
from parley.operators import chapters, facts, gate, retrieval, segmentation, timeline, topics, words
from parley.plans.ctes import REPLIES
from parley.registry import declare, operator
from parley.views import MEDIAN, MIDDLE, S, TOKENS, M, messages, sentiment, spoken, table, with_views

#: From this cosine on a vector counts as of its nearest kind.
LEAST_LIKE = 0.52
QUERY = "the license token of que the secret http"
_CAST = "list_transform({}, lambda x: cast(x as double))"
_QUERY = f"""q as (select distinct unnest(regexp_extract_all(lower('{QUERY}'), '[\\p{{L}}\\p{{N}}]+')) as token), nq as (select count(*) as terms from q), nd as (select count(*) as n from documents),
h as (select distinct t.doc_id, t.token from tokens t join q using (token)), w as (select q.token, ln((1 + n) * 1e0 / (1 + coalesce(df, 0))) + 1 as idf from q left join (select token, count(*) as df from h group by 1) d using (token), nd),
lex as (select doc_id, count(*) as hits, (select terms from nq) as terms, sum(idf) / (select sum(idf) from w) as overlap from h join w using (token) group by 1)"""
_VECTOR = f"vq as (select embedding as qv from embeddings where vec_id = 11), vec as (select vec_id as doc_id, list_dot_product({_CAST.format('embedding')}, {_CAST.format('qv')}) as likeness from embeddings, vq)"
_FUSED = """kr as (select *, row_number() over (order by round(overlap, 9) desc, doc_id) as rank from lex), vr as (select *, row_number() over (order by likeness desc, doc_id) as rank from vec),
fused as (select coalesce(a.doc_id, b.doc_id) as doc_id, a.rank as keyword_rank, b.rank as vector_rank, (coalesce(1e0 / (60 + a.rank), 0) + coalesce(1e0 / (60 + b.rank), 0)) * (0.45 + 0.55 * coalesce(a.hits * 1e0 / a.terms, 0)) as score
  from (select * from kr where rank <= 40) a full join (select * from vr where rank <= 40) b on a.doc_id = b.doc_id)"""


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where("vec_id = 11").select("embedding").first()
    return list(row[0]) if row else []


def _channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lexical = retrieval.lexical(table(spark, sf_dir, "documents"), QUERY).withColumn("overlap", F.round("overlap", 9))
    return lexical, retrieval.vector_scores(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir))


@operator("ret_01", f"with {TOKENS}, {_QUERY}, {_VECTOR}, {_FUSED} select doc_id, keyword_rank, vector_rank, round(score + 1e-9, 6) as score from fused order by fused.score desc, doc_id limit 16")
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector channels, 40 each, fused by ranks: the best 16."""
    lexical, vector = _channels(spark, sf_dir)
    return retrieval.fused(retrieval.top(lexical, "overlap"), retrieval.top(vector, "likeness")).withColumn("score", rounded(F.col("score"), 6))


@operator("ret_02", f"with {TOKENS}, {_QUERY} select doc_id, hits, terms, round(overlap + 1e-9, 6) as overlap from lex")
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a query's idf weight that each document holds."""
    return retrieval.lexical(table(spark, sf_dir, "documents"), QUERY).withColumn("overlap", rounded(F.col("overlap"), 6))


@operator("ret_03", f"""with {TOKENS}, {_QUERY}, {_VECTOR}, b as (select d.doc_id, coalesce(l.overlap, 0) as kw, v.likeness as vec, greatest(0.2e0, exp(-((select max(doc_id) from documents) - d.doc_id) / 60e0)) as recency, case d.lang when 'en' then 1e0 else 0.5e0 end as kind
  from documents d left join lex l using (doc_id) left join vec v using (doc_id))
select doc_id, round(case when vec is null then 0.65 * kw + 0.25 * recency + 0.1 * kind else 0.4 * greatest(0, vec) + 0.25 * kw + 0.25 * recency + 0.1 * kind end + 1e-9, 5) as score from b where kw > 0 or vec >= 0.3""")
def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector, keyword, recency and kind in one score; without a keyword the vector must be like enough."""
    lexical, vector = _channels(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    newest = docs.agg(F.max("doc_id").alias("_newest"))
    b = docs.join(lexical.select("doc_id", F.col("overlap").alias("kw")), "doc_id", "left").join(vector, "doc_id", "left").na.fill(0.0, ["kw"]).where("kw > 0 or likeness >= 0.3").join(F.broadcast(newest))
    recency, kind = retrieval.decayed(F.col("_newest") - F.col("doc_id"), 60.0), F.when(F.col("lang") == "en", 1.0).otherwise(0.5)
    rest = 0.25 * recency + 0.1 * kind
    score = F.when(F.col("likeness").isNull(), 0.65 * F.col("kw") + rest).otherwise(0.4 * F.greatest(F.lit(0.0), F.col("likeness")) + 0.25 * F.col("kw") + rest)
    return b.select("doc_id", rounded(score, 5).alias("score"))


@operator("ret_04", f"""with {TOKENS}, {_QUERY}, b as (select l.doc_id, l.hits, l.overlap * greatest(0.2e0, exp(-((select max(doc_id) from documents) - l.doc_id) / 180e0)) * case when lb.toxic = 1 then 0.5e0 else 1e0 end as score from lex l left join labels lb using (doc_id) where hits >= 2)
select doc_id, hits, round(score + 1e-9, 6) as score from b order by b.score desc, doc_id limit 20""")
def fact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that share two terms with a query, by overlap, age and label."""
    docs = table(spark, sf_dir, "documents")
    newest = docs.agg(F.max("doc_id").alias("_newest"))
    l = retrieval.lexical(docs, QUERY).where("hits >= 2").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left").join(F.broadcast(newest))
    score = F.col("overlap") * retrieval.decayed(F.col("_newest") - F.col("doc_id"), 180.0) * F.when(F.col("toxic") == 1, 0.5).otherwise(1.0)
    return l.select("doc_id", "hits", score.alias("raw")).orderBy(F.desc("raw"), "doc_id").limit(20).select("doc_id", "hits", rounded(F.col("raw"), 6).alias("score"))


@operator("ret_05", f"with {TOKENS}, {_QUERY} select l.doc_id, l.hits, coalesce(lb.toxic, 0) as sensitive from lex l left join labels lb using (doc_id) where coalesce(lb.toxic, 0) = 0 or hits >= 2")
def sensitive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitive documents only where they share two terms with the query."""
    l = retrieval.lexical(table(spark, sf_dir, "documents"), QUERY)
    joined = l.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left").withColumn("sensitive", F.coalesce("toxic", F.lit(0)))
    return joined.where("sensitive = 0 or hits >= 2").select("doc_id", "hits", "sensitive")


#: Turns ask for what the turns before them hold: kinds, scores and fits by the remainders of their numbers.
_GATE_KINDS = ("fact_memory", "topic_segment", "hot_context", "relationship_state", "self_style_example", "evidence_excerpt", "other")
_MODES = ("", "memory_request", "relationship_context")
_SEEN = 5


@operator("ret_06", f"""with q as (select conv_id, turn, conv_id * 1000 + turn as query_id, [{", ".join(f"'{m}'" for m in _MODES)}][(conv_id + turn) % 3 + 1] as mode, (conv_id + 2 * turn) % 29 = 0 as late, (conv_id * 7 + turn) % 31 = 0 as secret from conversations),
i as (select q.query_id, q.mode, t.turn, q.turn - t.turn as rank, [{", ".join(f"'{k}'" for k in _GATE_KINDS)}][(t.conv_id * 3 + t.turn * 5) % 7 + 1] as kind, ((t.conv_id * 37 + t.turn * 11) % 100) / 100e0 as score, ((t.conv_id * 17 + t.turn * 23) % 100) / 100e0 as task,
  (t.conv_id + q.turn + t.turn) % 4 = 0 as off, (t.conv_id + t.turn) % 3 = 0 as shares from q join conversations t on t.conv_id = q.conv_id and q.turn - t.turn between 1 and {_SEEN}),
k as (select *, kind = 'fact_memory' and (score >= 0.3 or (mode = 'memory_request' and shares)) as f, mode = 'memory_request' and kind in ('fact_memory', 'topic_segment', 'evidence_excerpt') and not off and (task >= 0.5 or (kind = 'fact_memory' and score >= 0.1 and shares)) as m,
  mode = 'relationship_context' and kind = 'relationship_state' and not off and (task >= 0.35 or score >= 0.25) as r, kind in ('hot_context', 'fact_memory', 'evidence_excerpt') and not off and task >= 0.62 and score >= 0.48 as o, kind = 'self_style_example' and not off and (task >= 0.35 or score >= 0.35) as s from i),
a as (select query_id, count(*) as n, count(*) filter (where off) as n_off, arg_min(kind, rank) as top_kind, arg_min(score, rank) as top_score, max(task) as best_task, bool_or(kind = 'fact_memory' and score >= 0.1) as weak,
  count(*) filter (where f) as nf, arg_min(score, rank) filter (where f) as fs, arg_min(task, rank) filter (where f) as ft, count(*) filter (where m) as nm, arg_min(score, rank) filter (where m) as ms, arg_min(task, rank) filter (where m) as mt,
  count(*) filter (where r) as nr, arg_min(score, rank) filter (where r) as rs, arg_min(task, rank) filter (where r) as rt, count(*) filter (where o) as no, arg_min(score, rank) filter (where o) as os, arg_min(task, rank) filter (where o) as ot,
  count(*) filter (where s) as ns, arg_min(score, rank) filter (where s) as ss, arg_min(task, rank) filter (where s) as st, arg_min(task, rank) as top_task from k group by 1),
d as (select q.query_id, a.*, case when late then 1 when secret then 2 when n is null then 3 when nf > 0 then case when mode = 'memory_request' then 4 else 5 end when nm > 0 and ms > 0 then 6 when top_kind = 'hot_context' and top_score >= 0.2 then 7
  when nr > 0 then 8 when no > 0 then 9 when ns > 0 then 10 when n_off = n then 11 when mode = 'memory_request' and weak then 12 else 13 end as w from q left join a on a.query_id = q.query_id)
select query_id, ['skip', 'no_hit', 'skip', 'inject', 'inject', 'inject', 'inject', 'weak_inject', 'inject', 'weak_inject', 'skip', 'skip', 'skip'][w] as action,
  ['timeout', 'sensitive_query_block', 'no_result', 'memory_request_match', 'fact_memory_match', 'memory_request_match', 'hot_context', 'weak_relationship_context', 'task_relevant_memory', 'style_context', 'off_topic_memory', 'memory_low_confidence', 'low_score'][w] as reason,
  case when w <= 3 then 0 when w <= 5 then fs when w = 6 then ms when w = 8 then rs when w = 9 then os when w = 10 then ss else top_score end as score, case when w <= 3 then 0 when w <= 5 then ft when w = 6 then mt when w = 7 then top_task when w = 8 then rt when w = 9 then ot when w = 10 then st else best_task end as task,
  case when w <= 3 or w >= 11 then 0 when w <= 5 then nf when w = 6 then nm when w = 7 then 1 when w = 8 then nr when w = 9 then no else ns end as n_selected, case when w <= 5 then 0 else n_off end as off_topic from d""")
def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what was found for each turn among those before it is worth using, and why."""
    c = table(spark, sf_dir, "conversations")
    pick = lambda values, place: F.element_at(F.array(*(F.lit(v) for v in values)), (place + 1).cast("int"))
    secret = F.when((F.col("conv_id") * 7 + F.col("turn")) % 31 == 0, gate.SENSITIVE[0] + gate.LOOKUPS[0]).otherwise("hello")
    q = c.select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), secret.alias("query"), pick(_MODES, (F.col("conv_id") + F.col("turn")) % 3).alias("mode"), ((F.col("conv_id") + 2 * F.col("turn")) % 29 == 0).alias("timed_out"), F.lit(False).alias("relationship"))
    seen = c.select("conv_id", F.col("turn").alias("t"), F.explode(F.sequence(F.lit(1), F.lit(_SEEN))).alias("rank")).withColumn("turn", F.col("t") + F.col("rank"))
    number = lambda a, b: ((F.col("conv_id") * a + F.col("t") * b) % 100) / 100
    items = seen.join(q.select("conv_id", "turn", "query_id"), ["conv_id", "turn"]).select(
        "query_id", "rank", pick(_GATE_KINDS, (F.col("conv_id") * 3 + F.col("t") * 5) % 7).alias("kind"), number(37, 11).alias("score"), number(17, 23).alias("task"),
        ((F.col("conv_id") + F.col("turn") + F.col("t")) % 4 == 0).alias("off_topic"), ((F.col("conv_id") + F.col("t")) % 3 == 0).alias("shares_term"),
    )
    return gate.decisions(q, items)


_SPOKEN = "sp as (select m.conversation_id, m.id, m.ts, m.ts_sec, cast(m.ts as date) as day, event_type || ' ' || regexp_replace(props, '[^0-9]', '', 'g') as content from m join events e on e.event_id = m.id)"
_DELIMITERS = r"[\s,，。！？；：、/()（）\[\]\-~～]+"
_COMPACT = r"regexp_replace(x, '\s+', '', 'g')"
_GRAMS = ", ".join(f"list_transform(range(1, greatest(length(c) - {n - 2}, 1)), lambda i: c[i:i + {n - 1}])" for n in (2, 3, 4))
#: The topics of each row and of the one to six rows before it, the masks of when a row cuts, a fold over each day's rows, and one over each conversation's segments.
_TOPICS_SQL = f"""with recursive {M}, {_SPOKEN},
r as (select *, row_number() over d as rn, lag(ts) over d as pts, ts_sec - lag(ts_sec) over d as gap from sp window d as (partition by conversation_id, day order by ts_sec, id)),
asked as (select * from r where gap >= 300), ks as (select unnest(range(0, 7)) as k),
ctx as (select a.conversation_id, a.day, a.rn, k, string_agg(b.content, ' ' order by b.rn) as x from asked a join ks on k < a.rn join r b on b.conversation_id = a.conversation_id and b.day = a.day
  and ((k = 0 and b.rn = a.rn) or (b.rn < a.rn and b.rn >= a.rn - k)) group by 1, 2, 3, 4),
tk as (select x, list_concat(list_filter(regexp_split_to_array(x, '{_DELIMITERS}'), lambda w: length(w) >= 2), {_GRAMS}) as ws from (select x, {_COMPACT} as c from (select distinct x from ctx))),
tp as (select x, list_filter(ws, lambda w, i: list_position(ws, w) = i)[1:8] as t from tk),
ov as (select a.conversation_id, a.day, a.rn, a.k, len(list_intersect(p.t, q.t)) * 1e0 / least(len(p.t), len(q.t)) as share from ctx a join tp p on p.x = a.x join ctx b on b.conversation_id = a.conversation_id and b.day = a.day and b.rn = a.rn and b.k = 0 join tp q on q.x = b.x where a.k > 0),
o as (select conversation_id, day, rn, list(share order by k) as shares from ov group by 1, 2, 3),
c as (select r.*, shares, gap > 0 and ((hour(pts) < 7 and hour(ts) >= 7) or gap > 7200) as forced from r left join o using (conversation_id, day, rn)),
f(conversation_id, day, rn, n, segment) as (select conversation_id, day, rn, 1, 0 from c where rn = 1 union all
  select conversation_id, day, rn, case when cut then 1 else n + 1 end, case when cut then segment + 1 else segment end from (select c.conversation_id, c.day, c.rn, f.n, f.segment,
    c.forced or (gap > 1800 and shares[least(f.n, 6)] <= 0.1) or (gap >= 300 and f.n >= 10 and shares[6] = 0) as cut from f join c on c.conversation_id = f.conversation_id and c.day = f.day and c.rn = f.rn + 1)),
g as (select f.conversation_id, f.day, f.segment, f.n, c.id, c.ts_sec, length(c.content) as chars from f join c using (conversation_id, day, rn)),
s as (select conversation_id, day, segment, min(ts_sec) as start_sec, max(ts_sec) as end_sec, count(*) as n, sum(chars) as chars, row_number() over (partition by conversation_id order by day, segment) as sn from g group by 1, 2, 3),
e as (select *, coalesce(lead(start_sec) over w - end_sec <= 1800, false) as close_next, coalesce(start_sec - lag(end_sec) over w <= 1800, false) as close_before from s window w as (partition by conversation_id order by sn)),
h(conversation_id, sn, begins, opens) as (select conversation_id, sn, true, n < 3 and close_next from e where sn = 1 union all
  select e.conversation_id, e.sn, not h.opens and not (e.n < 3 and not e.close_next and e.close_before), not h.opens and e.n < 3 and e.close_next from h join e on e.conversation_id = h.conversation_id and e.sn = h.sn + 1),
z as (select e.*, sum(begins::int) over (partition by e.conversation_id order by e.sn) - 1 as topic from e join h on h.conversation_id = e.conversation_id and h.sn = e.sn),
y as (select z.*, coalesce(sum(n) over (partition by conversation_id, topic order by sn rows between unbounded preceding and 1 preceding), 0) as ahead, sum(n) over (partition by conversation_id, topic) as tn, sum(chars) over (partition by conversation_id, topic) as tc from z),
k as (select g.conversation_id, topic, g.id, g.ts_sec, g.chars, ahead + g.n - 1 as k, tn, tn > 40 or tc > 3000 as large from g join y using (conversation_id, day, segment)),
v as (select conversation_id, topic, case when large then k // 28 - back else 0 end as part, id, ts_sec, chars from k, (values (0), (1)) as b(back)
  where case when large then k // 28 - back >= 0 and k // 28 - back < greatest(1, ceil((tn - 32) / 28e0) + 1) and k < (k // 28 - back) * 28 + 32 else back = 0 end)
select conversation_id, topic::bigint as topic, part::bigint as part, min(ts_sec) as start_sec, max(ts_sec) as end_sec, count(*) as n, sum(chars)::bigint as chars, min_by(id, (ts_sec, id)) as first_id, max_by(id, (ts_sec, id)) as last_id from v group by 1, 2, 3"""


@operator("ret_07", _TOPICS_SQL)
def topic_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic segments: cut at nights and long pauses, and at shorter ones where the words of the open segment's last messages don't come again; short ones merged,
    long ones in windows."""
    return topics.topic_segments(spoken(spark, sf_dir))


declare("ret_08", "Oversized days in windows of 32 messages, 28 apart.", """
with r as (select conversation_id, cast(ts as date) as day, id, row_number() over (partition by conversation_id, cast(ts as date) order by ts, id) - 1 as k, count(*) over (partition by conversation_id, cast(ts as date)) as n from {m}),
w as (select *, k {div} 28 as part from r where n > 40 union all select *, k {div} 28 - 1 as part from r where n > 40 and k >= 28 and k % 28 < 4)
select conversation_id, day, part, count(*) as n, min(id) as first_id, max(id) as last_id from w group by 1, 2, 3""")


#: Facts about events, whose times are drawn together as in a chat; a fact's evidence are three numbers that neighbouring events share.
HURRY, START, SPREAD = 40, 1_704_067_200, 60


def told_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).where("message_type <> 10000").join(sentiment(spark, sf_dir), F.col("id") == F.col("message_id"))
    seconds, first = F.expr(f"(ts_sec - {START}) div {HURRY} + {START}"), F.expr(f"id div {SPREAD}")
    return m.select("conversation_id", F.col("message_type").alias("kind"), "id", seconds.alias("ts_sec"), F.timestamp_seconds(seconds).alias("ts"), F.col("intensity").alias("score"), F.sequence(first, first + 2).alias("evidence"))


@operator("ret_09", f"""with recursive {M}, {S}, f as (select *, row_number() over (partition by conversation_id, kind order by ts, id) as rn from (select conversation_id, message_type as kind, id, (ts_sec - {START}) // {HURRY} + {START} as ts, intensity as score, id // {SPREAD} as p
  from m join s on s.message_id = m.id where message_type <> 10000)),
r(conversation_id, kind, rn, open, begun, cluster) as (select conversation_id, kind, rn, [struct_pack(n := 0, ts := ts, p := p)], 1, 0 from f where rn = 1 union all
  select conversation_id, kind, rn, list_append(list_filter(still, lambda x: x.n <> c), struct_pack(n := c, ts := ts, p := p)), greatest(begun, c + 1), c from (select *, coalesce(list_max(list_transform(list_filter(still, lambda x: abs(x.p - y.p) <= 1), lambda x: x.n)), begun) as c
  from (select f.*, r.begun, list_filter(r.open, lambda x: f.ts - x.ts <= 600) as still from r join f on f.conversation_id = r.conversation_id and f.kind = r.kind and f.rn = r.rn + 1) y))
select conversation_id, kind, arg_max(id, (score, -ts, -id)) as representative, arg_max(ts, (score, -ts, -id)) as source_sec, count(*) as n, array_to_string(list_sort(list_distinct(flatten(list([p, p + 1, p + 2])))), ',') as evidence
from f join r using (conversation_id, kind, rn) group by conversation_id, kind, cluster""")
def fact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of one kind within ten minutes of a cluster's last one that share two pieces of evidence with it, with the best member and all evidence."""
    found = facts.evidence_clusters(told_facts(spark, sf_dir))
    return found.withColumn("evidence", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ","))


@operator("ret_10", f"""with p as (select label, p as pos, avg(cast(embedding[p + 1] as double)) as x from embeddings, unnest(range(len(embedding))) as y(p) group by 1, 2),
c as (select label, list(x order by pos) as centre from p group by 1), s as (select v.vec_id, c.label, list_cosine_similarity({_CAST.format('v.embedding')}, c.centre) as sim from embeddings v, c)
select vec_id, max_by(label, (round(sim, 9), -label)) as nearest, round(max(sim) + 1e-9, 4) as sim, round(max(sim) + 1e-9, 4) >= {LEAST_LIKE} as matched from s group by 1""")
def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest prototype, the mean vectors of all kinds, which travel as one array of arrays, and whether it is
    like enough to be taken for one."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    means = v.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("c"))
    packed = centres.agg(F.array_sort(F.collect_list(F.struct("label", (F.transform("c", lambda x: x / F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, y: s + y * y)))).alias("c")))).alias("centres"))
    length = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    sims = F.transform("centres", lambda c: F.struct(F.round(dot(F.col("embedding"), c["c"]) / length, 9).alias("r"), (-c["label"]).alias("minus"), (dot(F.col("embedding"), c["c"]) / length).alias("sim")))
    best = v.join(F.broadcast(packed)).withColumn("best", F.array_max(sims))
    sim = rounded(F.col("best.sim"))
    return best.select("vec_id", (-F.col("best.minus")).alias("nearest"), sim.alias("sim"), (sim >= LEAST_LIKE).alias("matched"))


_SURE = "round(0.5e0 + (vec_id % 5) / 10e0, 1)"


@operator("ret_11", f"""with recursive v as (select label, vec_id, {_SURE} as confidence, {_CAST.format("embedding")} as x, row_number() over (partition by label order by {_SURE} desc, vec_id desc) as rn from embeddings),
r(label, rn, leaders, ids, slot) as (select label, rn, [x], [vec_id], 1 from v where rn = 1 union all
  select label, rn, case when slot is null and len(leaders) < 10 then list_append(leaders, x) else leaders end, case when slot is null and len(leaders) < 10 then list_append(ids, vec_id) else ids end,
    case when slot is null and len(leaders) < 10 then len(leaders) + 1 else slot end
  from (select v.*, leaders, ids, nullif(coalesce(list_position(list_transform(leaders, lambda c: list_cosine_similarity(c, v.x) >= {facts.LIKENESS}), true), 0), 0) as slot from r join v on v.label = r.label and v.rn = r.rn + 1))
select label, cast(slot - 1 as int) as slot, any_value(ids[slot]) as leader, count(*) as n, round(avg(confidence) + 1e-9, 4) as confidence, count(*) filter (where slot is null) as left_out from r join v using (label, rn) group by label, slot""")
def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of like vectors (cosine 0.72 or more), at most ten per label, the surest first; with their mean confidence, and what fits none."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("key"), F.col("vec_id").alias("id"), F.round(0.5 + (F.col("vec_id") % 5) / 10, 1).alias("confidence"), F.col("embedding").alias("vector"))
    found = facts.slots(v).groupBy(F.col("key").alias("label"), "slot").agg(F.max("leader").alias("leader"), F.count("*").alias("n"), rounded(F.avg("confidence")).alias("confidence"))
    return found.withColumn("left_out", F.when(F.col("slot").isNull(), F.col("n")).otherwise(0))


#: Facts are an event's kind and content in a conversation; the first half of the month is merged first, then the second; single errors are uncertain in between.
MIDDLE_OF_MONTH = 1_705_363_200


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.expr("user_id div 30").alias("conversation_id"), F.col("event_type").alias("kind"), F.col("props").alias("content"), F.col("event_id").alias("message_id"), (0.5 + (F.col("event_id") % 4) / 10).alias("confidence"), F.unix_timestamp("ts").alias("ts_sec"))


@operator("ret_12", f"""with e as (select user_id // 30 as conversation_id, event_type as kind, props as content, event_id as id, 0.5e0 + (event_id % 4) / 10e0 as sure, cast(floor(epoch(ts)) as bigint) as ts, epoch(ts) >= {MIDDLE_OF_MONTH} as late from events),
said as (select conversation_id, kind, content, arg_max(['inaccurate', 'forget', 'restore'][(id // 50) % 3 + 1], id) as action from e where id % 50 = 0 group by 1, 2, 3),
f as (select conversation_id, kind, content, count(*) as n, count(*) filter (where not late) as early, arg_min(sure, (late, ts, id)) as first, max(ts) as as_of from e group by 1, 2, 3),
u as (select f.*, action, kind = 'error' and early = 1 as doubted from f left join said using (conversation_id, kind, content))
select conversation_id, kind, content, n, round(least(0.95e0, first + 0.06 * (n - 1)), 4) as confidence, case when doubted then 'uncertain' else 'active' end as status, not doubted and coalesce(action, 'restore') = 'restore' as enabled, as_of,
  last_value(content) over w as head, count(*) over w - row_number() over (partition by conversation_id, kind order by content) as steps from u window w as (partition by conversation_id, kind order by content rows between unbounded preceding and unbounded following)""")
def fact_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts merged in two batches, with the user's word on them, and where each one's chain of successors (the next content of its kind) ends."""
    found = _findings(spark, sf_dir)
    action = F.element_at(F.array(*(F.lit(a) for a in ("inaccurate", "forget", "restore"))), (F.expr("message_id div 50") % 3 + 1).cast("int"))
    feedback = found.where("message_id % 50 = 0").select(*facts.KEY, action.alias("action"), F.col("message_id").alias("seq"))
    none = spark.createDataFrame([], "conversation_id long, kind string, content string, evidence array<long>, confidence double, status string, enabled boolean, as_of long")
    early = facts.merged_facts(none, found.where(f"ts_sec < {MIDDLE_OF_MONTH}"), feedback)
    doubted = (F.col("kind") == "error") & (F.size("evidence") == 1)
    early = early.withColumns({"status": F.when(doubted, "uncertain").otherwise(F.col("status")), "enabled": F.col("enabled") & ~doubted})
    merged = facts.merged_facts(early, found.where(f"ts_sec >= {MIDDLE_OF_MONTH}"), feedback).withColumn("id", F.concat_ws("|", *facts.KEY))
    own = Window.partitionBy("conversation_id", "kind").orderBy("content")  # a row per fact
    ends = facts.heads(merged.select("id", F.lead("id").over(own).alias("successor")))
    head = F.element_at(F.split("head", r"\|"), 3)
    return merged.join(ends, "id").select(*facts.KEY, F.size("evidence").cast("long").alias("n"), "confidence", "status", "enabled", "as_of", head.alias("head"), "steps")


declare("ret_13", "A snapshot of each conversation's state from profile and facts.", """
select m.conversation_id, count(*) as n, count(distinct m.member) as members, case when avg(s.intensity) > 0.1 then 'warm' when avg(s.intensity) < -0.1 then 'cool' else 'neutral' end as tone,
  count(case when m.message_type = 10000 then 1 end) * 5 > count(*) as many_notices from {m} m join {s} s on s.message_id = m.id group by 1""")


@operator("ret_14", f"""with {TOKENS}, t as (select doc_id, token, count(*) as n from tokens group by 1, 2), q as (select token, n from t where doc_id = 10), z as (select doc_id, sqrt(sum(n * n)) as norm from t group by 1),
newest as (select doc_id from documents where doc_id <> 10 order by doc_id desc limit 50), s as (select t.doc_id, sum(t.n * q.n) / (any_value(z.norm) * (select sqrt(sum(n * n)) from q)) as sim from t join q using (token) join z using (doc_id) join newest using (doc_id) group by 1)
select doc_id, round(sim + 1e-9, 4) as sim from s where sim >= 0.15 order by s.sim desc, doc_id limit 2""")
def thread_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the newest 50 documents the two most like another by word counts, if like enough."""
    docs = table(spark, sf_dir, "documents")
    newest = docs.where("doc_id <> 10").select("doc_id").orderBy(F.desc("doc_id")).limit(50)
    wanted = docs.join(F.broadcast(newest.union(docs.where("doc_id = 10").select("doc_id"))), "doc_id", "left_semi")
    t = wanted.select("doc_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    norms = t.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    q = t.where("doc_id = 10").select("token", F.col("n").alias("qn"))
    shared = t.where("doc_id <> 10").join(q, "token").groupBy("doc_id").agg(F.sum(F.col("n") * F.col("qn")).alias("shared")).join(norms, "doc_id")
    sims = shared.join(F.broadcast(norms.where("doc_id = 10").select(F.col("norm").alias("qnorm")))).select("doc_id", (F.col("shared") / (F.col("norm") * F.col("qnorm"))).alias("raw"))
    return sims.where("raw >= 0.15").orderBy(F.desc("raw"), "doc_id").limit(2).select("doc_id", rounded(F.col("raw")).alias("sim"))


#: A month of events as a year of chats; every third conversation as two months, too short for chapters. From the middle on, moods need more to be good.
YEAR, SHORT, TURN = 12, 2, START + 180 * 86_400


def seasons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Messages over a year, and their moods."""
    m = messages(spark, sf_dir)
    seconds = START + (F.col("ts_sec") - START) * F.when(F.col("conversation_id") % 3 == 0, SHORT).otherwise(YEAR)
    m = m.withColumn("ts_sec", seconds).withColumn("ts", F.timestamp_seconds("ts_sec").cast("timestamp_ntz"))
    early, late = (sentiment(spark, sf_dir, n).select("message_id", F.col("polarity").alias(c)) for n, c in ((MEDIAN, "early"), (MIDDLE, "late")))
    moods = m.select(F.col("id").alias("message_id"), "ts_sec").join(early, "message_id").join(late, "message_id")
    return m, moods.select("message_id", F.when(F.col("ts_sec") < TURN, F.col("early")).otherwise(F.col("late")).alias("polarity"))


def _year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.weekly_features(*seasons(spark, sf_dir))


@operator("chg_01")
def chapter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters: the optimal segmentation of each conversation's weekly features."""
    return segmentation.segments(_year(spark, sf_dir), chapters.FEATURES)


@operator("chg_02")
def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters with what changes from each to the next one, in deviations, from one half on."""
    return chapters.chapters(_year(spark, sf_dir)).withColumn("changes", F.to_json("changes"))


declare("chg_03", "Weekly trait scores per side, null with fewer than ten texts.", """
select conversation_id, cast(date_trunc('week', ts) as date) as week, is_sender, case when count(*) >= 10 then round(100 * avg(case when length(content) <= 14 then 0e0 else 1e0 end) + 1e-9, 3) end as score from {m} where message_type = 1 group by 1, 2, 3""")

@operator("chg_04")
def chapter_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of chapters where there are any, else one over the whole conversation."""
    m, moods = seasons(spark, sf_dir)
    return chapters.spans(chapters.chapters(chapters.weekly_features(m, moods)), m)


_SEASONS = f"""m as (select * replace (epoch_ms(({START} + (ts_sec - {START}) * case when conversation_id % 3 = 0 then {SHORT} else {YEAR} end) * 1000) as ts, {START} + (ts_sec - {START}) * case when conversation_id % 3 = 0 then {SHORT} else {YEAR} end as ts_sec) from ({M.removeprefix("m as ")}))"""


@operator("chg_05", f"""with {_SEASONS}, {REPLIES}, t as (select m.conversation_id, cast(date_trunc('week', m.ts) as date) as week, m.is_sender, m.ts_sec, least(1, round(e.value / case when m.ts_sec < {TURN} then {MEDIAN} else {MIDDLE} end - 1, 4)) as mood
  from m join events e on e.event_id = m.id where message_type = 1 and trim(content) <> ''),
f as (select conversation_id, week, count(*) as n, count(*) filter (where is_sender = 0) as theirs, count(*) filter (where mood > 0.3) as good, count(*) filter (where mood < -0.3) as bad from t group by 1, 2),
l as (select conversation_id, cast(date_trunc('week', ts) as date) as week, avg(response_sec) as seconds from replies group by 1, 2),
w as (select conversation_id, cast(unnest(generate_series(min(week), max(week), interval 7 day)) as date) as week from f group by 1),
x as (select conversation_id, week, coalesce(n, 0) as n, ln(1e0 + coalesce(n, 0)) as volume, coalesce(theirs * 1e0 / n, 0.5e0) as other_share, good * 1e0 / nullif(good + bad, 0) as pos_ratio, ln(1 + seconds / 60) as latency from w left join f using (conversation_id, week) left join l using (conversation_id, week))
select conversation_id, week, n, """ + ", ".join(f"round(coalesce({k}, avg({k}) over (partition by conversation_id), 0) + 1e-9, 4) as {k}" for k in chapters.FEATURES) + " from x")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly features that change points are found in, without gaps."""
    return _year(spark, sf_dir).select("conversation_id", "week", "n", *(rounded(F.col(c)).alias(c) for c in chapters.FEATURES))


declare("txt_01", "Words of all, mine and theirs in one pass.", """
select lang, token, count(*) as n, count(case when doc_id % 2 = 1 then 1 end) as mine, count(case when doc_id % 2 = 0 then 1 end) as theirs from {tokens} group by 1, 2 having count(*) >= 5""")


@operator("txt_02", with_views(['tokens'], """
with k as (select d.lang, count(*) as n, count(l.doc_id) as labelled from documents d left join labels l on l.doc_id = d.doc_id group by 1),
u as (select d.doc_id, d.lang, k.labelled * 10 >= k.n * 9 as by_label, l.doc_id is not null as has_label from documents d join k on k.lang = d.lang left join labels l on l.doc_id = d.doc_id),
t as (select u.lang, t.token, count(*) as n from tokens t join u on u.doc_id = t.doc_id where not u.by_label or u.has_label group by 1, 2)
select lang, token, n from t where n >= 5"""))
def segment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by segment of the corpus, from texts that are labelled where nearly all are, else from all."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("labels"))
    ids = docs.groupBy("doc_id", "lang").agg(F.count("*").alias("rows")).join(labels, "doc_id", "left")
    ids = ids.withColumn("times", F.col("rows") * F.coalesce("labels", F.lit(1)))  # what the join of rows and labels gives
    by_label = F.sum(F.when(F.col("labels").isNotNull(), F.col("times")).otherwise(0)) * 10 >= F.sum("times") * 9
    weights = ids.join(ids.groupBy("lang").agg(by_label.alias("by_label")), "lang").where("not by_label or labels is not null").select("doc_id", "lang", "times")
    return words.weighted_counts(docs, weights).where("n >= 5")



@operator("txt_03")
def inference_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts in batches of like length: range-partitioned by length, sorted within, 128 to a batch."""
    texts = table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies", F.length("text").alias("chars"))
    ranged = texts.repartitionByRange("chars", "doc_id").sortWithinPartitions("chars", "doc_id").withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("part").orderBy("chars", "doc_id")) - 1
    return ranged.withColumn("batch", (place / 128).cast("int")).select("doc_id", "copies", "chars", "part", "batch")


declare("txt_04", "Looked up by content in a cache: hits and misses.", """
with w as (select md5(text) as key, min(doc_id) as doc_id, count(*) as n from {documents} group by 1), k as (select distinct md5(text) as key from {documents} where doc_id % 3 = 0)
select w.doc_id, w.n, k.key is not null as hit from w left join k on k.key = w.key""")

declare("txt_05", "A weekly report in a sentence: this week against the one before.", """
with w as (select conversation_id, cast(date_trunc('week', ts) as date) as week, count(*) as n from {m} group by 1, 2),
r as (select *, lag(n) over (partition by conversation_id order by week) as before from w)
select conversation_id, week, concat(cast(n as varchar(20)), ' messages, ', case when before is null then 'the first week' when n > before then concat('up by ', cast(n - before as varchar(20))) when n < before then concat('down by ', cast(before - n as varchar(20))) else 'as many as before' end) as said from r""")
