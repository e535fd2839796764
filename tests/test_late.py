"""Snapshots after shuffled arrivals against a full run."""

import random

import pytest

from parley.streaming import late

SCHEMA = "conversation_id long, id long, ts_sec long"


def arrivals(seed=1, n=600):
    pick, rows, t = random.Random(seed), [], 1_700_000_000
    for i in range(n):
        t += pick.choice((5, 300, 1_799, 1_800, 1_801, 9_000, 40_000))
        rows.append((pick.randrange(7), i, t))
    batches = [[r for r in rows[100 * k : 100 * k + 100]] for k in range(6)]
    for k in (1, 3):  # some of two batches come later, some of them twice
        for r in pick.sample(batches[k], 8):
            batches[k].remove(r)
            batches[k + 2] += [r, r]
    batches[2] += batches[0][:5]
    for b in batches:
        pick.shuffle(b)
    return rows, batches


def snapshot(df):
    return {r.conversation_id: (r.n, r.first_sec, r.last_sec, r.sessions) for r in df.collect()}


@pytest.mark.parametrize("measure", [late.SESSIONS, late.Measure(late.pauses)])
def test_shuffled_arrivals_end_as_a_full_run(spark, tmp_path, measure):
    rows, batches = arrivals()
    store = late.SnapshotStore(str(tmp_path / "store"), measure)
    for k, b in enumerate(batches):
        for _ in range(2 if k in (0, 3) else 1):  # a batch that is run again
            store.write(spark.createDataFrame(b, SCHEMA), k)
        seen = [r for x in batches[: k + 1] for r in x]
        assert snapshot(store.snapshots(spark)) == snapshot(late.pauses(spark.createDataFrame(sorted(set(seen)), SCHEMA)))
    assert snapshot(store.snapshots(spark)) == snapshot(late.pauses(spark.createDataFrame(rows, SCHEMA)))
    how = {r.how for r in spark.read.parquet(str(tmp_path / "store" / "snapshots")).select("how").distinct().collect()}
    assert how == ({"full", "extended"} if measure.extended else {"full"})


def test_untouched_keys_are_not_written_again(spark, tmp_path):
    store = late.SnapshotStore(str(tmp_path / "store"), late.SESSIONS)
    store.write(spark.createDataFrame([(1, 1, 1_000), (2, 2, 1_000), (3, 3, 9_000)], SCHEMA), 0)
    store.write(spark.createDataFrame([(1, 4, 9_000), (3, 5, 2_000), (4, 6, 10)], SCHEMA), 1)
    got = {r.conversation_id: (r.batch_id, r.how, r.frontier_sec, r.sessions) for r in store.snapshots(spark).collect()}
    assert got == {1: (1, "extended", 9_000, 2), 2: (0, "full", 1_000, 1), 3: (1, "full", 9_000, 2), 4: (1, "extended", 10, 1)}
    store.write(spark.createDataFrame([(1, 4, 9_000)], SCHEMA), 2)  # nothing new
    assert {r.batch_id for r in store.snapshots(spark).collect()} == {0, 1}


def test_stream(spark, tmp_path):
    rows, batches = arrivals(5)
    for k, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = late.SnapshotStore(str(tmp_path / "store"), late.SESSIONS)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    store.stream(stream, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(180)
    assert snapshot(store.snapshots(spark)) == snapshot(late.pauses(spark.createDataFrame(rows, SCHEMA)))
