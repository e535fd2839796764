"""Late rows in a stream of messages: which keys they touch, and snapshots of those computed anew.

A store is a folder with a log of all rows and a table of snapshots, both with a partition per micro-batch. A batch
writes its rows and the snapshots of the keys it touches, into partitions of its own number, so that a batch which runs twice
leaves what it leaves once. The newest snapshot of a key counts; keys that a batch doesn't touch are not written again.

Rows that come in order extend a key's snapshot. A key with a row older than what its snapshot has seen is stale: it
is computed from all its rows, which are read from the log's buckets that hold touched keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY, BATCH = "conversation_id", "batch_id"
#: Buckets of the log: a touched key costs the reading of one of them.
BUCKETS = 64


@dataclass(frozen=True)
class Measure:
    """What a snapshot holds: ``full`` from all rows of some keys, a row per key; ``extended`` from snapshots and rows that come
    after all rows seen, or none if it can't be had so."""

    full: Callable[[DataFrame], DataFrame]
    extended: Callable[[DataFrame, DataFrame], DataFrame] | None = None


def touched(rows: DataFrame, frontiers: DataFrame) -> DataFrame:
    """``conversation_id, n, late, frontier_sec, earliest_sec, latest_sec, stale`` of the keys that ``rows(conversation_id, ts_sec)`` touch.

    ``frontiers`` are ``conversation_id, frontier_sec``: the newest time that each key's snapshot has seen. A row before it is late and makes
    the key stale. A row at the frontier's own second is not late.
    """
    joined = rows.select(KEY, "ts_sec").join(frontiers.select(KEY, "frontier_sec"), KEY, "left")
    late = F.col("ts_sec") < F.col("frontier_sec")
    found = joined.groupBy(KEY).agg(F.count("*").alias("n"), F.count_if(late).alias("late"), F.max("frontier_sec").alias("frontier_sec"), F.min("ts_sec").alias("earliest_sec"), F.max("ts_sec").alias("latest_sec"))
    return found.withColumn("stale", F.col("late") > 0)


class SnapshotStore:
    """Log and snapshots under one folder that all executors share. Rows are ``conversation_id, id, ts_sec`` and more; an id that comes again is one row."""

    def __init__(self, path: str, measure: Measure) -> None:
        self.path, self.measure = path, measure

    def _read(self, spark: SparkSession, part: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.path}/{part}")
        except AnalysisException:  # nothing is written yet
            return None

    def log(self, spark: SparkSession, until: int | None = None) -> DataFrame | None:
        held = self._read(spark, "log")
        return held if held is None or until is None else held.where(F.col(BATCH) <= until)

    def snapshots(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The newest snapshot of each key, of batches before one; with the number of the batch that wrote it."""
        held = self._read(spark, "snapshots")
        if held is None:
            return None
        held = held if before is None else held.where(F.col(BATCH) < before)
        names = [c for c in held.columns if c != KEY]
        return held.groupBy(KEY).agg(F.max_by(F.struct(*names), BATCH).alias("_s")).select(KEY, "_s.*")

    def write(self, rows: DataFrame, batch: int) -> None:
        """Takes a micro-batch in, as ``foreachBatch`` calls it; the same batch again replaces what it wrote."""
        spark = rows.sparkSession
        bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int"))
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/log/{BATCH}={batch}")
        prior = self.snapshots(spark, before=batch)
        new = spark.read.parquet(f"{self.path}/log/{BATCH}={batch}")
        known = self.log(spark, until=batch - 1)
        if known is not None and prior is not None:  # captures that came before don't count again
            new = new.join(known.where(F.col("bucket").isin(*self._buckets(new))).select(KEY, "id"), [KEY, "id"], "left_anti")
        new = new.dropDuplicates([KEY, "id"]).drop("bucket")
        frontiers = prior.select(KEY, "frontier_sec") if prior is not None else new.select(KEY, F.lit(None).cast("long").alias("frontier_sec")).limit(0)
        keys = touched(new, frontiers).select(KEY, "stale", F.greatest("frontier_sec", "latest_sec").alias("_frontier")).persist()
        try:
            fresh = self.measure.extended is not None and prior is not None
            anew = keys.where("stale") if fresh else keys
            parts = []
            if fresh:
                in_order = keys.where("not stale").select(KEY)
                parts.append(self.measure.extended(prior.join(in_order, KEY, "left_semi").drop("frontier_sec", "how", BATCH), new.join(in_order, KEY, "left_semi")).withColumn("how", F.lit("extended")))
            buckets = self._buckets(anew.withColumn("bucket", F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int")))
            if buckets:
                own = self.log(spark, until=batch).where(F.col("bucket").isin(*buckets)).join(anew.select(KEY), KEY, "left_semi")
                parts.append(self.measure.full(own.dropDuplicates([KEY, "id"]).drop("bucket", BATCH)).withColumn("how", F.lit("full")))
            if not parts:
                return
            found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            found.join(keys.select(KEY, F.col("_frontier").alias("frontier_sec")), KEY).write.mode("overwrite").parquet(f"{self.path}/snapshots/{BATCH}={batch}")
        finally:
            keys.unpersist()

    @staticmethod
    def _buckets(rows: DataFrame) -> list[int]:
        """The buckets of some rows, as many as there are at most."""
        return [r.bucket for r in rows.select("bucket").distinct().collect()]

    def stream(self, messages: DataFrame, checkpoint: str):  # noqa: ANN201
        """A running query that keeps the snapshots of a stream up to date."""
        return messages.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)


def pauses(rows: DataFrame, gap: int = 1_800) -> DataFrame:
    """``conversation_id, n, first_sec, last_sec, sessions``: a measure whose value depends on the order of time, from all rows of some keys."""
    w = Window.partitionBy(KEY, F.expr("ts_sec div 86400")).orderBy("ts_sec", "id")
    days = rows.withColumns({"_day": F.expr("ts_sec div 86400"), "_gap": F.col("ts_sec") - F.lag("ts_sec").over(w)})
    days = days.groupBy(KEY, "_day").agg(F.count("*").alias("n"), F.min("ts_sec").alias("first_sec"), F.max("ts_sec").alias("last_sec"), F.count_if(F.col("_gap") > gap).alias("inner"))
    before = F.lag("last_sec").over(Window.partitionBy(KEY).orderBy("_day"))
    joined = days.withColumn("_new", F.coalesce(F.col("first_sec") - before > gap, F.lit(True)).cast("long"))
    return joined.groupBy(KEY).agg(F.sum("n").alias("n"), F.min("first_sec").alias("first_sec"), F.max("last_sec").alias("last_sec"), F.sum(F.col("inner") + F.col("_new")).alias("sessions"))


def pauses_extended(prior: DataFrame, rows: DataFrame, gap: int = 1_800) -> DataFrame:
    """The same from snapshots and rows after them."""
    new = pauses(rows, gap).select(KEY, *(F.col(c).alias(f"_{c}") for c in ("n", "first_sec", "last_sec", "sessions")))
    both = new.join(prior, KEY, "left")
    joins = F.coalesce((F.col("_first_sec") - F.col("last_sec") <= gap).cast("long"), F.lit(0))
    return both.select(
        KEY, (F.coalesce("n", F.lit(0)) + F.col("_n")).alias("n"), F.coalesce("first_sec", "_first_sec").alias("first_sec"), F.greatest("last_sec", "_last_sec").alias("last_sec"),
        (F.coalesce("sessions", F.lit(0)) + F.col("_sessions") - joins).alias("sessions"),
    )


SESSIONS = Measure(pauses, pauses_extended)
