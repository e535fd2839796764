"""Whether what was retrieved for a query is worth using, and why: a table of decisions over each query's items.

What the decisions ask of the items is an aggregate per query and kind, so that all queries are judged in one pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of documents that each way of using them allows, and what asks for sensitive data.
ORDINARY = ("hot_context", "fact_memory", "evidence_excerpt", "feedback_example")
MEMORY = ("fact_memory", "topic_segment", "evidence_excerpt", "shared_memory", "dialogue_turn")
RELATIONSHIP = ("relationship_state", "contact_preference", "communication_style")
STYLE = ("self_style_example", "communication_style")
SENSITIVE = ("身份证", "身份证号", "手机号", "电话号码", "银行卡", "银行卡号", "详细住址", "具体住址", "家庭住址", "病历", "病史", "诊断记录")
LOOKUPS = ("是多少", "是什么", "找出来", "查一下", "告诉我", "发给我", "给我看")


@dataclass(frozen=True)
class Thresholds:
    fact: float = 0.30
    memory_task: float = 0.50
    memory_floor: float = 0.10
    hot: float = 0.20
    relationship_task: float = 0.35
    relationship_score: float = 0.25
    ordinary_task: float = 0.62
    ordinary_score: float = 0.48
    style: float = 0.35


def asks_for_sensitive(query: Column) -> Column:
    text = F.regexp_replace(F.coalesce(query, F.lit("")), r"(?U)\s+", "")
    return text.rlike("|".join(map(re.escape, SENSITIVE))) & text.rlike("|".join(map(re.escape, LOOKUPS)))


def decisions(queries: DataFrame, items: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """``query_id, action, reason, score, task, n_selected, off_topic`` for each of ``queries(query_id, query, mode, timed_out, relationship)``.

    ``items`` are ``query_id, rank, kind, score, task, off_topic, shares_term``, best first by ``rank``: how well an item scores, how it fits the task, whether it is off
    topic, whether it shares a term with the query. ``mode`` is ``memory_request``, ``relationship_context`` or anything else; ``relationship`` says that the query asks
    about a relation. The first that holds decides: a timeout; a query for sensitive data; no items; facts; memories asked for; a hot context on top; relationship
    and task items; style; all off topic; facts too weak to say that there are none; else the score is too low.
    """
    rows = items.join(queries.select("query_id", F.coalesce("mode", F.lit("")).alias("mode"), F.coalesce("relationship", F.lit(False)).alias("asked")), "query_id")
    kind, score, task = F.col("kind"), F.coalesce("score", F.lit(0.0)), F.coalesce("task", F.lit(0.0))
    on, shared, memory = ~F.coalesce("off_topic", F.lit(False)), F.coalesce("shares_term", F.lit(False)), F.col("mode") == "memory_request"
    fact = kind == "fact_memory"
    ways = {
        "facts": fact & ((score >= t.fact) | (memory & shared)),
        "memories": memory & kind.isin(*MEMORY) & on & ((task >= t.memory_task) | (fact & (score >= t.memory_floor) & shared)),
        "related": ((F.col("mode") == "relationship_context") | F.col("asked")) & kind.isin(*RELATIONSHIP) & on & ((task >= t.relationship_task) | (score >= t.relationship_score)),
        "ordinary": kind.isin(*ORDINARY) & on & (task >= t.ordinary_task) & (score >= t.ordinary_score),
        "styles": kind.isin(*STYLE) & on & ((task >= t.style) | (score >= t.style)),
    }
    best = F.struct(kind.alias("kind"), F.round(score, 4).alias("score"), task.alias("task"))
    each = [x for w, c in ways.items() for x in (F.count_if(c).alias(f"n_{w}"), F.min_by(F.when(c, best), F.when(c, F.col("rank"))).alias(w))]
    found = rows.groupBy("query_id").agg(
        F.count("*").alias("n"), F.min_by(best, "rank").alias("top"), F.max(task).alias("best_task"), F.count_if(~on).alias("n_off"), F.bool_or(fact & (score >= t.memory_floor)).alias("weak_fact"), *each
    )
    rows = queries.select("query_id", asks_for_sensitive(F.col("query")).alias("secret"), F.coalesce("mode", F.lit("")).alias("mode"), F.coalesce("timed_out", F.lit(False)).alias("late")).join(found, "query_id", "left")
    some = lambda w: F.coalesce(F.col(f"n_{w}") > 0, F.lit(False))
    asked = F.col("mode") == "memory_request"
    ladder = (
        (F.col("late"), "skip", "timeout", None), (F.col("secret"), "no_hit", "sensitive_query_block", None), (F.col("n").isNull(), "skip", "no_result", None),
        (some("facts") & asked, "inject", "memory_request_match", "facts"), (some("facts"), "inject", "fact_memory_match", "facts"),
        (some("memories") & (F.col("memories.score") > 0), "inject", "memory_request_match", "memories"), ((F.col("top.kind") == "hot_context") & (F.col("top.score") >= t.hot), "inject", "hot_context", "top"),
        (some("related"), "weak_inject", "weak_relationship_context", "related"), (some("ordinary"), "inject", "task_relevant_memory", "ordinary"), (some("styles"), "weak_inject", "style_context", "styles"),
        (F.col("n_off") == F.col("n"), "skip", "off_topic_memory", "none"), (asked & F.col("weak_fact"), "skip", "memory_low_confidence", "none"), (F.lit(True), "skip", "low_score", "none"),
    )

    def chosen(of) -> Column:  # noqa: ANN001
        out = None
        for met, action, reason, way in ladder:
            out = F.when(met, of(action, reason, way)) if out is None else out.when(met, of(action, reason, way))
        return out

    value = lambda field, rest: lambda a, r, w: F.lit(0.0) if w is None else rest if w == "none" else F.col(f"{w}.{field}")
    n = lambda a, r, w: F.lit(1 if w == "top" else 0).cast("long") if w in (None, "none", "top") else F.col(f"n_{w}")
    off = lambda a, r, w: F.lit(0).cast("long") if w in (None, "facts") else F.col("n_off")
    return rows.select(
        "query_id", chosen(lambda a, r, w: F.lit(a)).alias("action"), chosen(lambda a, r, w: F.lit(r)).alias("reason"), chosen(value("score", F.col("top.score"))).alias("score"),
        chosen(value("task", F.col("best_task"))).alias("task"), chosen(n).alias("n_selected"), chosen(off).alias("off_topic"),
    )
