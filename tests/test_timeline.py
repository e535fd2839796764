"""Hand-computed cases of the order-dependent scans, and their independence of order and partitions."""

import datetime
import random

import pytest

from parley.operators import timeline

DAY0 = datetime.datetime(2024, 3, 1)


def messages(spark, rows, parts=3):
    """rows: (id, conversation, seconds since midnight of day 0, side)."""
    data = [(i, c, DAY0 + datetime.timedelta(seconds=s), int((DAY0 - datetime.datetime(1970, 1, 1)).total_seconds()) + s, side, f"m{i}") for i, c, s, side in rows]
    return spark.createDataFrame(data, "id long, conversation_id long, ts timestamp_ntz, ts_sec long, is_sender int, content string").repartition(parts)


def units(df):
    return sorted((r.conversation_id, r.unit_id, r.is_sender, list(r.message_ids)) for r in timeline.speech_units(df).collect())


def test_unit_gaps(spark):
    df = messages(spark, [(1, 0, 0, 1), (2, 0, 299, 1), (3, 0, 599, 1), (4, 0, 600, 0), (5, 0, 601, 1)])
    assert units(df) == [(0, 1, 1, [1, 2]), (0, 2, 1, [3]), (0, 3, 0, [4]), (0, 4, 1, [5])]


def test_units_go_over_midnight(spark):
    df = messages(spark, [(1, 0, 86_300, 1), (2, 0, 86_450, 1), (3, 0, 86_500, 0), (4, 0, 5 * 86_400, 0)])
    assert units(df) == [(0, 1, 1, [1, 2]), (0, 2, 0, [3]), (0, 3, 0, [4])]


def sessions(df):
    return sorted((r.conversation_id, r.session_id, r.unit_count, r.initiator) for r in timeline.sessions(df).collect())


@pytest.mark.parametrize(("a", "b", "n"), [(36_000, 37_800, 1), (36_000, 37_801, 2), (24_900, 25_300, 2), (3_600, 4_200, 1), (86_300, 86_450, 2)])
def test_session_gaps(spark, a, b, n):
    """Half an hour, a second more, over seven o'clock, at night, over midnight."""
    assert len(sessions(messages(spark, [(1, 0, a, 1), (2, 0, b, 0)]))) == n


def test_replies(spark):
    df = messages(spark, [(1, 0, 36_000, 1), (2, 0, 36_060, 0), (3, 0, 36_070, 0), (4, 0, 36_070 + 86_400, 1), (5, 0, 36_071 + 3 * 86_400, 0)])
    got = {r.reply_id: (r.sent_id, r.direction, r.abnormal, r.response_sec) for r in timeline.response_times(df).collect()}
    assert got[2] == (1, "me_to_other", False, 60)
    assert got[4] == (3, "other_to_me", False, 86_400 - 7 * 3600)
    assert got[5] == (4, "me_to_other", True, None)
    assert 3 not in got


def test_a_pause_within_the_night_counts_in_full(spark):
    df = messages(spark, [(1, 0, 3600, 1), (2, 0, 3 * 3600, 0)])
    assert timeline.response_times(df).first().response_sec == 7200


def test_carried_values_are_those_of_whole_windows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [(i, rng.randrange(3), rng.randrange(20 * 86_400), rng.randrange(2)) for i in range(800)]
    df = timeline.with_day(messages(spark, rows))
    whole = Window.partitionBy("conversation_id").orderBy("ts", "id")
    want = df.withColumn("q", F.lag("is_sender").over(whole)).select("id", F.lag("id").over(whole).alias("p"), F.sum(F.when(F.col("q") == F.col("is_sender"), 0).otherwise(1)).over(whole).alias("r"))
    got = timeline.with_runs(df, "r", ["is_sender", "id"], F.col("prev_is_sender") != F.col("is_sender"), ["conversation_id"], ["ts", "id"]).select("id", F.col("prev_id").alias("p"), "r")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_order_and_partitions_do_not_matter(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, rng.randrange(3 * 86_400), rng.randrange(2)) for i in range(300)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert units(messages(spark, rows, 1)) == units(messages(spark, shuffled, 7))


def test_streaks_and_no_rows(spark):
    days = spark.createDataFrame([(0, DAY0.date() + datetime.timedelta(d)) for d in (0, 1, 2, 5, 6, 9)], "conversation_id long, day date")
    assert sorted(r.days for r in timeline.streaks(days, ["conversation_id"]).collect()) == [1, 2, 3]
    empty = messages(spark, [(1, 0, 0, 1)]).where("false")
    assert timeline.sessions(empty).count() == timeline.interaction_pairs(empty).count() == 0
