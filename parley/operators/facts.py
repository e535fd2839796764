"""Remembered facts: merging of what is found again, chains of facts that replace each other, clusters of shared evidence, slots of like ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.numbers import cosine
from parley.operators import timeline
from parley.operators.lineage import staged

#: What each further piece of evidence adds to a fact's confidence, and where that ends.
CONFIRMATION, CEILING = 0.06, 0.95
#: States that finding a fact again doesn't undo.
FINAL = ("superseded", "uncertain")
CLUSTER_SECONDS, LEAST_SHARED = 600, 2
LIKENESS, MOST_SLOTS = 0.72, 10
KEY = ["conversation_id", "kind", "content"]


def merged_facts(facts: DataFrame, found: DataFrame, feedback: DataFrame) -> DataFrame:
    """``conversation_id, kind, content, evidence, confidence, status, enabled, as_of`` after a batch of findings.

    ``facts`` are rows as this gives them; ``found`` are ``conversation_id, kind, content, message_id, confidence, ts_sec``, a row per evidence;
    ``feedback`` is ``conversation_id, kind, content, action, seq`` by the user. A fact is known by its key: evidence is united, the first
    confidence grows by a step per further piece of evidence up to a ceiling. Facts that are superseded or uncertain stay so and stay disabled;
    others become active and enabled, unless the user's latest word on them is anything but ``restore``: that always wins. Merging a batch twice
    gives what merging it once gives.
    """
    new = found.groupBy(*KEY).agg(F.array_sort(F.collect_set("message_id")).alias("new_evidence"), F.min_by("confidence", F.struct("ts_sec", "message_id")).alias("first"), F.max("ts_sec").alias("seen"))
    said = feedback.groupBy(*KEY).agg(F.max_by("action", "seq").alias("action"))
    both = facts.join(new, KEY, "full").join(said, KEY, "left")
    none = F.array().cast("array<bigint>")
    evidence = F.array_sort(F.array_union(F.coalesce("evidence", none), F.coalesce("new_evidence", none)))
    further = F.size(evidence) - F.greatest(F.size(F.coalesce("evidence", none)), F.lit(1))
    confidence = F.least(F.greatest(F.lit(CEILING), "confidence"), F.coalesce("confidence", "first") + CONFIRMATION * further)
    final = F.coalesce(F.col("status").isin(*FINAL), F.lit(False))
    refreshed = F.col("new_evidence").isNotNull()
    status = F.when(final | ~refreshed, F.col("status")).otherwise("active")
    enabled = F.when(final | ~refreshed, F.coalesce("enabled", F.lit(False))).otherwise(True) & (F.coalesce("action", F.lit("restore")) == "restore")
    return both.select(*KEY, evidence.alias("evidence"), F.round(confidence, 4).alias("confidence"), status.alias("status"), enabled.alias("enabled"), F.greatest("as_of", "seen").alias("as_of"))


def heads(links: DataFrame) -> DataFrame:
    """``id, head, steps``: where the chain of successors that begins at each id ends, for ``links(id, successor)``, a row per id.

    Pointers are doubled: after each round a row points twice as far, so that a chain of a thousand takes ten rounds. An id without a
    successor is its own head, as is a successor that has no row. Ids on a cycle, or before one, have no head.
    """
    rows = links.select("id", F.coalesce("successor", "id").alias("to"), F.when(F.col("successor").isNull() | (F.col("successor") == F.col("id")), 0).otherwise(1).cast("long").alias("steps"))
    rows = staged(rows.withColumn("ends", F.col("steps") == 0))
    rounds = max(1, rows.count()).bit_length() + 1
    for _ in range(rounds):
        further = rows.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("ends").alias("_ends"))
        moved = rows.where("not ends").join(further, "to", "left")
        moved = moved.select("id", F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_ends", F.lit(True)).alias("ends"))
        rows = staged(rows.where("ends").unionByName(moved))
        if rows.where("not ends").isEmpty():
            break
    return rows.select("id", F.when(F.col("ends"), F.col("to")).alias("head"), F.when(F.col("ends"), F.col("steps")).alias("steps"))


def evidence_clusters(facts: DataFrame, seconds: int = CLUSTER_SECONDS, shared: int = LEAST_SHARED) -> DataFrame:
    """``conversation_id, kind, representative, source_sec, n, evidence`` of clusters of ``facts(conversation_id, kind, id, ts, ts_sec, score, evidence)``.

    In order of time a fact joins the latest begun cluster of its kind whose last fact is at most so many seconds older and shares two pieces of
    evidence or more; else it begins one. The best fact, the earliest of equals, represents a cluster. Facts of a kind fall apart where none
    comes within that time: each such island is folded by itself, in a task that holds the last facts of the clusters that may still grow.
    """
    rows = timeline.with_day(facts.withColumn("evidence", F.array_distinct("evidence")))
    gap = F.col("ts_sec") - F.col("prev_ts_sec") > seconds
    islands = timeline.with_runs(rows, "island", ["ts_sec"], gap, ["conversation_id", "kind"], ["ts_sec", "id"]).select("conversation_id", "kind", "island", "id", "ts_sec", "score", "evidence")
    schema = islands.schema.add("cluster", "long")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_, begun = None, {}, 0
        for batch in batches:
            clusters = []
            for c, k, i, ts, evidence in zip(*(batch[x].tolist() for x in ("conversation_id", "kind", "island", "ts_sec", "evidence")), strict=True):
                if (c, k, i) != key:
                    key, open_, begun = (c, k, i), {}, 0
                open_ = {n: last for n, last in open_.items() if ts - last[0] <= seconds}
                own = set(evidence if evidence is not None else ())
                joined = next((n for n in sorted(open_, reverse=True) if len(own & open_[n][1]) >= shared), None)
                if joined is None:
                    joined, begun = begun, begun + 1
                open_[joined] = ts, own
                clusters.append(joined)
            yield batch.assign(cluster=clusters)

    placed = islands.repartition("conversation_id", "kind", "island").sortWithinPartitions("conversation_id", "kind", "island", "ts_sec", "id").mapInPandas(fold, schema)
    best = F.struct("score", -F.col("ts_sec"), -F.col("id"))
    found = placed.groupBy("conversation_id", "kind", "island", "cluster").agg(F.max_by(F.struct("id", "ts_sec"), best).alias("best"), F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
    return found.select("conversation_id", "kind", F.col("best.id").alias("representative"), F.col("best.ts_sec").alias("source_sec"), "n", "evidence")


def slots(facts: DataFrame, likeness: float = LIKENESS, most: int = MOST_SLOTS) -> DataFrame:
    """``key, id, confidence, slot, leader`` of ``facts(key, id, confidence, vector)``: the first fact of a key, by confidence and then by id, both descending,
    leads a slot; all like enough to it are its members; of the rest the first one leads the next slot, up to so many. What is left has none.

    That is what taking the facts one by one into the first slot that fits gives. A round finds each key's leader by an aggregate and judges all
    facts in parallel, so that no task holds a key's facts.
    """
    rest = staged(facts.select("key", "id", "confidence", "vector"))
    done: DataFrame | None = None
    for slot in range(most):
        leaders = rest.groupBy(F.col("key").alias("_key")).agg(F.max_by(F.struct("id", "vector"), F.struct("confidence", "id")).alias("l"))
        like = F.coalesce(cosine(F.col("vector"), F.col("l.vector")) >= likeness, F.lit(False)) | (F.col("id") == F.col("l.id"))
        judged = staged(rest.join(leaders, F.col("key").eqNullSafe(F.col("_key"))).select("key", "id", "confidence", "vector", F.col("l.id").alias("leader"), like.alias("like")))
        taken = judged.where("like").select("key", "id", "confidence", F.lit(slot).alias("slot"), "leader")
        done = taken if done is None else done.unionByName(taken)
        rest = judged.where("not like").select("key", "id", "confidence", "vector")
        if rest.isEmpty():
            return done
    return done.unionByName(rest.select("key", "id", "confidence", F.lit(None).cast("int").alias("slot"), F.lit(None).cast(facts.schema["id"].dataType).alias("leader")))


def best_overlap(windows: DataFrame) -> DataFrame:
    """``key, count, weight, expected_start, actual_start, coverage, weight_ratio`` of ``windows(key, expected, actual)``: the longest run of tokens that two
    windows have in common, wherever it lies in either.

    A token of ``expected`` weighs the more the earlier it is. Equal tokens of both lie on diagonals; neighbours on a diagonal are runs. Of equally
    long runs the heavier one counts, then the one that begins earlier, in ``expected`` and then in ``actual``. Windows without a common token have
    counts of zero and starts of -1. Empty tokens are left out before positions are counted. A window is a bounded context: pairs of equal
    tokens are as many as both windows' repetitions allow.
    """
    clean = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    rows = windows.select("key", clean("expected").alias("expected"), clean("actual").alias("actual"))
    a = rows.select("key", F.size("expected").alias("n"), F.posexplode("expected").alias("i", "token"))
    b = rows.select("key", F.posexplode("actual").alias("j", "token"))
    met = a.join(b, ["key", "token"]).select("key", "n", "i", (F.col("j") - F.col("i")).alias("shift"))
    place = F.col("i") - F.row_number().over(Window.partitionBy("key", "shift").orderBy("i"))
    runs = met.withColumn("run", place).groupBy("key", "n", "shift", "run").agg(F.count("*").alias("count"), F.min("i").alias("i"), F.sum(F.col("n") - F.col("i")).alias("weight"))
    best = runs.groupBy("key").agg(F.max(F.struct("count", "weight", (-F.col("i")).alias("i"), (-F.col("shift") - F.col("i")).alias("j"))).alias("b"))
    n = F.size("expected")
    got = lambda c, missing: F.coalesce(c, F.lit(missing).cast("long"))
    count, weight = got(F.col("b.count"), 0), got(F.col("b.weight"), 0)
    return rows.join(best, "key", "left").select(
        "key", count.alias("count"), weight.alias("weight"), got(-F.col("b.i"), -1).alias("expected_start"), got(-F.col("b.j"), -1).alias("actual_start"),
        F.when(n > 0, count / n).otherwise(0.0).alias("coverage"), F.when(n > 0, weight / (n * (n + 1) / 2)).otherwise(0.0).alias("weight_ratio"),
    )
