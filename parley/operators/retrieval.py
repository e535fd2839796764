"""Hybrid retrieval over texts and vectors: lexical weights, vector likeness, rank fusion and gates."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.numbers import dot
from parley.functions.text import tokens

#: Rank fusion: a rank r gives 1 / (RRF + r).
RRF, POOL, SHOWN = 60, 40, 16


def lexical(docs: DataFrame, query: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, hits, terms, overlap``: the share of the query's idf weight that a document holds, of those that hold any.

    Only the query's own terms leave the scan: a document gives one row per term that it holds. A text that lies whole
    within the query scores 0.2 more.
    """
    terms = F.array_distinct(tokens(F.lit(query)))
    trimmed = F.trim(F.col(text))
    within = F.when(F.contains(F.lower(F.lit(query)), F.lower(trimmed)) & (F.length(trimmed) > 0), 0.2).otherwise(0.0)
    own = docs.select(doc_id, within.alias("within"), F.array_intersect(F.array_distinct(tokens(F.col(text))), terms).alias("held"), terms.alias("terms"))
    # a few words per document that holds any: kept, since both the weights and the scores need them
    held = own.where(F.size("held") > 0).persist(StorageLevel.MEMORY_AND_DISK)
    counted = docs.agg(F.count("*").alias("n"))
    df = held.select(F.explode("held").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    # one row: the corpus size and a map of the query's terms to their weights
    weights = df.join(F.broadcast(counted)).select("n", "token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")).agg(F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("idf"), F.max("n").alias("_n"))
    missing = F.log(1 + F.col("_n").cast("double")) + 1
    total = lambda words: F.aggregate(words, F.lit(0.0), lambda s, w: s + F.coalesce(F.element_at("idf", w), missing))
    scored = held.join(F.broadcast(weights))
    return scored.select(doc_id, F.size("held").alias("hits"), F.size("terms").alias("terms"), (total(F.col("held")) / total(F.col("terms")) + F.col("within")).alias("overlap"))


def vector_scores(vectors: DataFrame, query: list[float], vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    literal = F.array(*(F.lit(float(x)) for x in query))
    return vectors.where(F.size(vector) == len(query)).select(F.col(vec_id).alias("doc_id"), dot(F.col(vector), literal).alias("likeness"))


def top(scored: DataFrame, score: str, k: int = POOL) -> DataFrame:
    """The ``k`` best rows with their ``rank``; the window runs over those alone."""
    best = scored.orderBy(F.desc(score), "doc_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "doc_id")))


def fused(keyword: DataFrame, vector: DataFrame, shown: int = SHOWN) -> DataFrame:
    """Both channels' ranks added up, times how much of the query a document covers."""
    a = keyword.select("doc_id", F.col("rank").alias("keyword_rank"), (F.col("hits") / F.col("terms")).alias("coverage"))
    b = vector.select("doc_id", F.col("rank").alias("vector_rank"))
    part = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    score = (part("keyword_rank") + part("vector_rank")) * (0.45 + 0.55 * F.coalesce("coverage", F.lit(0.0)))
    return a.join(b, "doc_id", "full").select("doc_id", "keyword_rank", "vector_rank", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(shown)


def decayed(age_days: Column, tau: float) -> Column:
    return F.greatest(F.lit(0.2), F.exp(-age_days / tau))
