"""Rankings, quotas, samples and set operations."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.numbers import dot, rounded
from parley.functions.text import bound, tokens
from parley.operators import sampling, timeline, words
from parley.operators.lineage import staged
from parley.registry import declare, operator
from parley.views import MEDIAN, TOKENS, doc_tokens, messages, sentiment, table, with_views

declare("top_01", "The 50 most frequent words with weights from 1 to 100; in a large text only words that occur three times.", """
with n as (select token as word, count(*) as n from {tokens} where length(token) >= 2 group by 1),
f as (select word, n from n where n >= case when (select sum(n) from n) >= 300 then 3 else 1 end),
top as (select word, n from f order by n desc, word limit 50), k as (select word, n, row_number() over (order by n desc, word) as rank from top)
select word, n, rank, cast(floor(1 + 99.0 * (n - (select min(n) from k)) / greatest(1, (select max(n) from k) - (select min(n) from k)) + 1e-9) as int) as weight from k""")


@operator("top_02", with_views(['tokens'], """
with n as (select d.lang, t.token as word, count(*) as n from tokens t join documents d on d.doc_id = t.doc_id group by 1, 2),
r as (select *, row_number() over (partition by lang order by n desc, word) as rank from n) select lang, word, n, rank from r where rank <= 10"""))
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most used words of each language."""
    docs = table(spark, sf_dir, "documents")
    n = words.weighted_counts(docs, docs.groupBy("doc_id", "lang").agg(F.count("*").alias("times"))).withColumnRenamed("token", "word")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return n.withColumn("rank", rank).where("rank <= 10").select("lang", "word", "n", "rank")



@operator("top_03", """with q as (select embedding as qv from embeddings where vec_id = 3), k as (select vec_id, list_dot_product(list_transform(embedding, lambda x: cast(x as double)), list_transform(qv, lambda x: cast(x as double))) as score from embeddings, q)
select vec_id, round(score + 1e-9, 4) as score from k order by k.score desc, vec_id limit 40""")
def vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 vectors most like a query vector."""
    v = table(spark, sf_dir, "embeddings")
    query = v.where("vec_id = 3").select("embedding").first()
    vector = F.array(*(F.lit(float(x)) for x in (query[0] if query else [])))
    scored = v.select("vec_id", dot(F.col("embedding"), vector).alias("raw")).orderBy(F.desc("raw"), "vec_id").limit(40)
    return scored.select("vec_id", rounded(F.col("raw")).alias("score"))


_KEYWORDS = ("the", "de", "und", "token", "license")


@operator("top_04", f"""with {TOKENS}, k as (select distinct doc_id, token as keyword, list_position({list(_KEYWORDS)}, token) as place from tokens where token in {_KEYWORDS}),
r as (select *, row_number() over (partition by keyword order by doc_id desc) as rank from k) select doc_id, min(place) as place, min(rank) as rank from r where rank <= 12 group by 1""")
def newest_by_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per keyword the newest twelve documents, each document once with its first keyword."""
    places = F.array_position(F.array(*(F.lit(k) for k in _KEYWORDS)), F.col("token"))
    held = doc_tokens(spark, sf_dir).where(F.col("token").isin(*_KEYWORDS)).select("doc_id", "token", places.alias("place")).distinct()
    ranked = held.withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("doc_id")))).where("rank <= 12")
    return ranked.groupBy("doc_id").agg(F.min("place").alias("place"), F.min("rank").alias("rank"))


def greedy_phrases(candidates: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """From ``candidates(keys, phrase, n)`` the first ``keep`` by count that neither hold nor are held by an accepted one.

    A round folds the ``8 * keep`` best per key that clash with none of those accepted so far. Where these don't fill the list and more are left, the next
    round takes what comes after them; each accepts at least one more. Only such heads go to one task.
    """
    most = 8 * keep
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("phrase"))))
    clash = lambda a, x: F.exists(a, lambda y: F.contains(y["phrase"], x["phrase"]) | F.contains(x["phrase"], y["phrase"]))
    empty = F.expr("cast(array() as array<struct<k:bigint,phrase:string>>)")
    fold = F.aggregate("all", F.col("before"), lambda a, x: F.when((F.size(a) >= keep) | clash(a, x), a).otherwise(F.concat(a, F.array(x))))
    same = reduce(and_, (F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys))

    def folded(rows: DataFrame, before: DataFrame | None) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "phrase"))
        heads = rows.withColumn("_rank", place).where(F.col("_rank") <= most).groupBy(*keys).agg(order.alias("all"))
        if before is None:
            heads = heads.withColumn("before", empty)
        else:
            heads = heads.alias("c").join(before.alias("o"), same).select("c.*", F.col("o.top").alias("before"))
        found = heads.select(*keys, fold.alias("top"), (F.size("all") == most).alias("more"), F.element_at("all", -1).alias("last"))
        return staged(found.withColumn("open", F.col("more") & (F.size("top") < keep)))

    rows = staged(candidates.select(*keys, "phrase", F.col("n").cast("long").alias("n")))
    heads = folded(rows, None)
    done = heads.where("not open").select(*keys, "top")
    while not (left := heads.where("open")).isEmpty():
        x = F.struct((-F.col("c.n")).alias("k"), F.col("c.phrase").alias("phrase"))
        later = rows.alias("c").join(left.alias("o"), same).where(x > F.col("o.last")).where(~bound(x, lambda y: clash(F.col("o.top"), y))).select("c.*")
        heads = folded(later, left)
        ended = left.alias("c").join(heads.alias("o"), same, "left_anti").select(*keys, "top")  # nothing without a clash was left
        done = done.union(ended).union(heads.where("not open").select(*keys, "top"))
    return done.select(*keys, F.posexplode("top").alias("place", "t")).select(*keys, "place", F.col("t.phrase").alias("phrase"), (-F.col("t.k")).alias("n"))


@operator("top_05")
def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve most frequent word pairs of each language that don't contain one another."""
    words = table(spark, sf_dir, "documents").select("lang", tokens(F.col("text")).alias("w"))
    neighbours = F.inline(F.expr("arrays_zip(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, greatest(size(w) - 1, 0)))")).alias("a", "b")
    pairs = words.select("lang", neighbours).select("lang", F.concat("a", F.lit(" "), "b").alias("phrase"))
    return greedy_phrases(pairs.groupBy("lang", "phrase").agg(F.count("*").alias("n")).where("n >= 3"), ["lang"], 12)


declare("top_06", "A quota of 40 messages, round robin over polarities, the largest group first.", """
with r as (select m.conversation_id, m.id, s.polarity, row_number() over (partition by m.conversation_id, s.polarity order by m.ts, m.id) as k,
  count(*) over (partition by m.conversation_id, s.polarity) as n from {m} m join {s} s on s.message_id = m.id),
o as (select *, row_number() over (partition by conversation_id order by k, n desc, polarity) as place from r where k <= 40)
select conversation_id, id, polarity, place from o where place <= 40""")

@operator("top_07")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most forty exchanges and 8,000 characters per conversation, from its beginning, its worst week, its last month and after its silences."""
    m = messages(spark, sf_dir, sparse=True)
    found = timeline.interaction_pairs(m)
    moods = sentiment(spark, sf_dir, MEDIAN).select(F.col("message_id").alias("first"), "polarity")
    pairs = found.select("conversation_id", F.col("unit_id").alias("pair_id"), F.col("prev_start_sec").alias("ts_sec"), (F.col("n_chars") + F.col("prev_n_chars")).alias("chars"), F.col("message_ids")[0].alias("first")).join(moods, "first").drop("first")
    now = m.agg(F.max("ts_sec")).first()[0] or 0
    return sampling.stratified(pairs, timeline.sessions(m).select("conversation_id", "start_sec", "end_sec"), now)


declare("top_08", "Twenty messages evenly spread, both ends kept.", """
with r as (select conversation_id, id, row_number() over (partition by conversation_id order by ts, id) - 1 as k, count(*) over (partition by conversation_id) as n from {m})
select conversation_id, id, k from r where n <= 20 or (k * 19 + (n - 1) - 1) {div} (n - 1) * (n - 1) {div} 19 = k or k = n - 1 or k = 0""")

declare("set_01", "Documents of several terms, each term a subquery of its own.", """
select doc_id, 'license' as term from {documents} where lower(text) like '%license%'
union all select doc_id, 'token' as term from {documents} where lower(text) like '%token%'
union all select doc_id, 'http' as term from {documents} where lower(text) like '%http%'""")

declare("set_02", "Distinct contents by their first occurrence.", """
with r as (select conversation_id, content, min(id) as first_id from {m} group by 1, 2)
select conversation_id, first_id, row_number() over (partition by conversation_id order by first_id) as place from r""")

declare("set_03", "Snapshots that are not among the newest two of their key.", """
with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from {orders})
select o.o_custkey, o.o_orderkey from {orders} o where not exists (select 1 from r where r.o_orderkey = o.o_orderkey and r.k <= 2)""")


@operator("set_04", f"""with {TOKENS}, k as (select doc_id, list_sort(list_distinct(list(token))) as ws from tokens where length(token) >= 4 group by 1)
select a.doc_id, len(list_intersect(a.ws, b.ws)) as shared, len(list_distinct(list_concat(a.ws, b.ws))) as joint, len(list_intersect(a.ws, b.ws)) >= 2 as related from k a join k b on b.doc_id = a.doc_id + 1""")
def evidence_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and union of neighbouring documents' word sets."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) >= 4))
    own = table(spark, sf_dir, "documents").select("doc_id", words.alias("ws")).where("size(ws) > 0")
    following = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("ws").alias("others"))
    shared = F.size(F.array_intersect("ws", "others"))
    return own.join(following, "doc_id").select("doc_id", shared.alias("shared"), F.size(F.array_union("ws", "others")).alias("joint"), (shared >= 2).alias("related"))


declare("set_05", "Distinct union, intersection and difference of two sets of members.", """
select 'union' as kind, member from (select member from {m} where is_sender = 1 union select member from {m} where is_sender = 0) a
union all select 'intersect' as kind, member from (select member from {m} where message_type = 47 intersect select member from {m} where message_type = 43) b
union all select 'except' as kind, member from (select member from {m} where id % 50 = 0 except select member from {m} where id % 70 = 0) c""")
