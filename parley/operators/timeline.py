"""Order-dependent scans over timelines, spread over days.

A window over a whole conversation would put a hot one into one task. Here windows run within a conversation's day
only; what crosses midnight is carried by a second table of one row per conversation and day. The helpers give what
``lag`` and a running ``sum`` over the whole conversation would.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds: a unit's messages follow each other within less than the first; a session ends after more than the second.
UNIT_GAP, SESSION_GAP = 300, 1800
NIGHT_END = 7
DAY = 86_400


def with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.to_date("ts"))


def with_previous(rows: DataFrame, columns: list[str], keys: list[str], order: list[str], bucket: str = "day") -> DataFrame:
    """``rows`` with ``prev_<column>`` of the row before, by ``order`` within ``keys``; ``bucket`` must follow the order."""
    own = Window.partitionBy(*keys, bucket).orderBy(*order)
    last = rows.groupBy(*keys, bucket).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    carried = last.select(*keys, bucket, F.lag("_last").over(Window.partitionBy(*keys).orderBy(bucket)).alias("_carried"))
    inner = rows.withColumn("_first", F.row_number().over(own) == 1).withColumns({f"prev_{c}": F.lag(c).over(own) for c in columns})
    joined = inner.join(carried, [*keys, bucket], "left")
    return joined.withColumns({f"prev_{c}": F.when(F.col("_first"), F.col("_carried")[c]).otherwise(F.col(f"prev_{c}")) for c in columns}).drop("_first", "_carried")


def with_last(rows: DataFrame, columns: list[str], n: int, key: str = "conversation_id", order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """``rows(day, ...)`` with an array ``last`` of up to ``n`` rows that end with each, as a window over the whole ``key`` would give.

    Windows run within days. Each day's last rows are kept as one array, and a window over days carries what the days before leave:
    every day has a row, so that ``n - 1`` of them are enough.
    """
    own = Window.partitionBy(key, "day").orderBy(*order)
    inner = rows.withColumns({"_in": F.collect_list(F.struct(*columns)).over(own.rowsBetween(-(n - 1), 0)), "_late": F.lead(F.lit(1), n - 1).over(own).isNull()})
    tails = inner.where("_late").groupBy(key, "day").agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(order)), F.struct(*columns).alias("_row")))).alias("_tail"))
    before = F.collect_list("_tail").over(Window.partitionBy(key).orderBy("day").rowsBetween(-(n - 1), -1))
    carried = tails.select(key, "day", F.transform(F.flatten(before), lambda x: x["_row"]).alias("_carried"))
    every = F.concat(F.coalesce("_carried", F.array().cast(inner.schema["_in"].dataType)), "_in")
    joined = inner.join(carried, [key, "day"], "left").withColumn("_all", every)
    return joined.withColumn("last", F.slice("_all", F.greatest(F.lit(1), F.size("_all") - (n - 1)), F.lit(n))).drop("_in", "_late", "_carried", "_all")


def with_runs(rows: DataFrame, name: str, columns: list[str], starts: Column, keys: list[str], order: list[str], bucket: str = "day") -> DataFrame:
    """``rows`` with ``prev_<column>`` as in :func:`with_previous`, and the number ``name`` of the run that a row belongs to.

    ``starts`` tells from ``columns`` and their ``prev_`` counterparts whether a row begins a run; null, as for a first row, says it does.
    """
    begins = F.coalesce(starts, F.lit(True)).cast("long")
    own = Window.partitionBy(*keys, bucket).orderBy(*order)
    inner = rows.withColumns({"_n": F.row_number().over(own)} | {f"prev_{c}": F.lag(c).over(own) for c in columns})
    inner = inner.withColumn("_own", F.sum(F.when(F.col("_n") > 1, begins).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    days = inner.groupBy(*keys, bucket).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"), F.min_by(F.struct(*columns), F.struct(*order)).alias("_head"), F.max("_own").alias("_total"))
    over = Window.partitionBy(*keys).orderBy(bucket)
    days = days.withColumn("_carried", F.lag("_last").over(over)).select("*", *(F.col("_head")[c].alias(c) for c in columns), *(F.col("_carried")[c].alias(f"prev_{c}") for c in columns))
    days = days.withColumn("_begins", begins)
    before = F.coalesce(F.sum(F.col("_total") + F.col("_begins")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = days.select(*keys, bucket, "_carried", (before + F.col("_begins")).alias("_before"))
    joined = inner.join(carried, [*keys, bucket], "left")
    joined = joined.withColumns({f"prev_{c}": F.when(F.col("_n") == 1, F.col("_carried")[c]).otherwise(F.col(f"prev_{c}")) for c in columns})
    return joined.withColumn(name, F.col("_own") + F.col("_before")).drop("_n", "_own", "_before", "_carried")


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` kept for the several scans that follow; what an executor loses is computed again from its lineage."""
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def speech_units(messages: DataFrame, gap: int = UNIT_GAP) -> DataFrame:
    """Runs of one side's messages with less than ``gap`` seconds between neighbours: one row per unit."""
    starts = (F.col("prev_is_sender") != F.col("is_sender")) | (F.col("ts_sec") - F.col("prev_ts_sec") >= gap)
    numbered = with_runs(with_day(messages), "unit_id", ["is_sender", "ts_sec"], starts, ["conversation_id"], ["ts", "id"])
    units = numbered.groupBy("conversation_id", "unit_id").agg(
        F.min("is_sender").alias("is_sender"), F.min("ts").alias("ts"), F.min("ts_sec").alias("start_sec"), F.max("ts").alias("end_ts"), F.max("ts_sec").alias("end_sec"),
        F.count("*").alias("n_messages"), F.sum(F.length("content")).alias("n_chars"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "id"))), lambda x: x["id"]).alias("message_ids"),
    )
    return kept(units)


def crosses_sleep(start: Column, end: Column) -> Column:
    """Whether a pause spans the night: another day, or from before seven to seven or later."""
    return (F.to_date(start) != F.to_date(end)) | ((F.hour(start) < NIGHT_END) & (F.hour(end) >= NIGHT_END))


def begins_session(start: str = "ts", end: str = "ts", gap: int = SESSION_GAP) -> Column:
    """Whether a row begins a session, from ``prev_<end>``; null for a first row, which does."""
    pause = F.unix_timestamp(start) - F.unix_timestamp(f"prev_{end}")
    return (pause > gap) | crosses_sleep(F.col(f"prev_{end}"), F.col(start))


def session_ids(rows: DataFrame, gap: int = SESSION_GAP, start: str = "ts", end: str = "ts", order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """``rows`` with a ``session_id`` that grows by one after each long pause or night."""
    starts = begins_session(start, end, gap)
    return with_runs(rows.withColumn("day", F.to_date(start)), "session_id", list(dict.fromkeys([start, end])), starts, ["conversation_id"], list(order)).drop(f"prev_{end}", f"prev_{start}")


def sessions(messages: DataFrame, gap: int = SESSION_GAP) -> DataFrame:
    """Sessions of speech units: one row each, with the side that began."""
    units = session_ids(speech_units(messages), gap, "ts", "end_ts", ("ts", "unit_id"))
    found = units.groupBy("conversation_id", "session_id").agg(
        F.min("ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.count("*").alias("unit_count"),
        F.sum("n_messages").alias("message_count"), F.min_by("is_sender", F.struct("ts", "unit_id")).alias("initiator"),
    )
    return kept(found)


def interaction_pairs(messages: DataFrame) -> DataFrame:
    """Neighbouring units of different sides: the later one with the former's columns as ``prev_...``."""
    units = speech_units(messages).withColumn("day", F.to_date("ts"))
    linked = with_previous(units, ["unit_id", "is_sender", "start_sec", "end_sec", "n_chars", "n_messages"], ["conversation_id"], ["ts", "unit_id"])
    return linked.where("prev_is_sender <> is_sender").withColumn("gap_sec", F.col("start_sec") - F.col("prev_end_sec"))


def overlap_with_nights(start: Column, end: Column) -> Column:
    """Seconds of [start, end] between midnight and seven, for spans of at most a day (epoch seconds, UTC)."""
    midnight = start - F.pmod(start, F.lit(DAY))
    part = lambda day: F.greatest(F.lit(0), F.least(end, midnight + day * DAY + NIGHT_END * 3600) - F.greatest(start, midnight + day * DAY))
    return part(0) + part(1)


def response_times(messages: DataFrame) -> DataFrame:
    """Each message that follows one of the other side, with the seconds between them; nights taken off where slept through.

    More than a day, or less than nothing, is abnormal and has no time.
    """
    linked = with_previous(with_day(messages), ["is_sender", "ts_sec", "ts", "id"], ["conversation_id"], ["ts", "id"])
    raw = F.col("ts_sec") - F.col("prev_ts_sec")
    abnormal = (raw < 0) | (raw > DAY)
    slept = F.when(crosses_sleep(F.col("prev_ts"), F.col("ts")), overlap_with_nights(F.col("prev_ts_sec"), F.col("ts_sec"))).otherwise(0)
    return linked.where("prev_is_sender <> is_sender").select(
        "conversation_id", F.col("prev_id").alias("sent_id"), F.col("id").alias("reply_id"), "ts", F.when(F.col("prev_is_sender") == 1, "me_to_other").otherwise("other_to_me").alias("direction"),
        abnormal.alias("abnormal"), F.when(~abnormal, F.greatest(F.lit(0), raw - slept)).alias("response_sec"),
    )


def streaks(days: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """Runs of days in a row: ``keys``, first and last day, number of days. ``days`` has a row per key and day."""
    anchor = F.date_sub(day, F.row_number().over(Window.partitionBy(*keys).orderBy(day)))
    return days.withColumn("_anchor", anchor).groupBy(*keys, "_anchor").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days")).drop("_anchor")
