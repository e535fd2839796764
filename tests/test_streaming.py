"""Streams against their batch forms, over files that come one by one."""

import datetime
import random

from pyspark.sql import functions as F

from parley.streaming import triggers

SCHEMA = "conversation_id long, id long, ts_sec long, polarity int, intensity double, confidence double, boundary boolean, dull boolean, strong boolean, substantive boolean"


def run(spark, tmp_path, query, name, n=None):
    """What a query writes of all files that are there; one with timers never ends by itself and is stopped after ``n`` rows."""
    out = str(tmp_path / name)
    writer = query.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-check")).outputMode("append")
    q = writer.trigger(availableNow=True).start() if n is None else writer.start()
    try:
        for _ in range(120):
            if q.awaitTermination(1) or (n is not None and sum(p["numInputRows"] for p in q.recentProgress) >= n):
                return spark.read.parquet(out)
    finally:
        q.stop()
    raise AssertionError("the stream doesn't come to its end")


def tracked(data, rules=triggers.RULES):
    """Each conversation's messages one by one through the tracker, and silences by the gaps."""
    out = []
    for key in {r[0] for r in data}:
        tracker, before = triggers.Tracker(), None
        for r in sorted((r for r in data if r[0] == key), key=lambda r: (r[2], r[1])):
            if before and r[2] - before[2] > rules.silence:
                out.append((key, before[1], before[2] + rules.silence, "silence", 0.0))
            out += [(key, r[1], r[2], name, r[4]) for name in tracker.take(r[1:], rules)]
            before = r
        out.append((key, before[1], before[2] + rules.silence, "silence", 0.0))
    return sorted(out)


def told(df):
    return sorted((r.conversation_id, r.id, r.ts_sec, r.trigger, r.level) for r in df.collect())


def rows(conversations=3, n=900, seed=2):
    """Messages in moods of a few lengths, with ties in time, bursts, pauses over midnight and days with a single row."""
    rng = random.Random(seed)
    moods = [[0.9, 0.8, 0.9, -0.9], [0.1, 0.2, -0.1, 0.1], [-0.6, -0.9, -0.8, -0.7, -0.9], [0.9, 0.8, 0.7, 0.9, 0.6], [0.4, -0.4, 0.2], [0.0, 0.0, 0.0]]
    data, t, i = [], 1_700_000_000, 0
    while i < n:
        t += rng.choice((40_000, 90_000)) if rng.random() < 0.04 else rng.choice((60, 200, 300, 700))
        side, calm, slow = rng.randrange(conversations), rng.random() < 0.5, rng.random() < 0.5
        for level in rng.choice(moods) + rng.choice(moods):
            t += rng.choice((100, 140, 300)) if slow else rng.choice((0, 1, 20, 59, 60, 61))
            polarity = 1 if level > 0.3 else -1 if level < -0.3 else 0
            data.append((side, i, t, polarity, level, rng.choice((0.5, 0.9, 0.9)), rng.random() < 0.05, calm and polarity == 0, rng.random() < 0.8, rng.random() < 0.2))
            i += 1
    return data


def test_the_batch_is_the_fold_over_each_conversation(spark):
    data = rows()
    got = triggers.triggers_batch(spark.createDataFrame(data, SCHEMA).repartition(5))
    assert told(got) == tracked(data)
    assert {w[3] for w in tracked(data)} == set(triggers.PAUSES)
    assert {(r.trigger, r.severity) for r in got.select("trigger", "severity").distinct().collect()} == set(triggers.SEVERITIES.items())


def test_other_rules_hold_on_both_sides(spark):
    rules = triggers.Rules(shift_span=1_000, least_sure=0.0, least_strong=0, happy=0.1, span=120, silence=200, pauses=dict.fromkeys(triggers.PAUSES, 45))
    data = rows(2, 400, 9)
    assert told(triggers.triggers_batch(spark.createDataFrame(data, SCHEMA), rules)) == tracked(data, rules) != tracked(data)


def test_the_stream_is_the_batch(spark, tmp_path):
    """In files that come one by one; the state is written and read again between them."""
    triggers.needs_rocksdb(spark)
    data = sorted(rows(3, 240, 4), key=lambda r: (r[2], r[1]))
    for k in range(3):
        spark.createDataFrame(data[k * len(data) // 3 : (k + 1) * len(data) // 3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, tmp_path, triggers.triggers_stream(stream), "out", len(data)).where("trigger <> 'silence'")
    assert told(got) == [w for w in tracked(data) if w[3] != "silence"]


def test_a_start_warms_the_windows_and_fires_nothing(spark, tmp_path):
    triggers.needs_rocksdb(spark)
    data = sorted(rows(2, 120, 6), key=lambda r: (r[2], r[1]))
    cut = data[60][2]
    frame = spark.createDataFrame(data, SCHEMA)
    start = triggers.baseline(frame, cut)
    assert {r["count"] for r in start.groupBy("conversation_id").count().collect()} == {triggers.WINDOW}
    frame.where(f"ts_sec > {cut}").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(spark, tmp_path, triggers.triggers_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), start=start), "out", sum(r[2] > cut for r in data)).where("trigger <> 'silence'")
    want = []
    for key in (0, 1):
        tracker = triggers.Tracker()
        own = [r for r in data if r[0] == key]
        for r in [r for r in own if r[2] <= cut][-triggers.WINDOW :]:
            tracker.take(r[1:], warming=True)
        want += [(key, r[1], r[2], name, r[4]) for r in own if r[2] > cut for name in tracker.take(r[1:])]
    assert told(got) == sorted(want) and want


def test_silence_is_told_once_by_the_clock(spark, tmp_path):
    triggers.needs_rocksdb(spark)
    rules = triggers.Rules(silence=2)
    spark.createDataFrame(rows(1, 20), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = triggers.triggers_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), rules)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            q.awaitTermination(2)
            got = spark.read.schema(triggers.FIRED).parquet(str(tmp_path / "out")).where("trigger = 'silence'")
            if got.count():
                break
        q.awaitTermination(6)
        assert got.count() == 1
    finally:
        q.stop()


def test_rules():
    seen = lambda ts, polarity, intensity, dull=False, boundary=False, sure=0.9, strong=True, substantive=False: (0, ts, polarity, intensity, sure, boundary, dull, strong, substantive)

    def fires(*messages):
        tracker = triggers.Tracker()
        return [tracker.take(m) for m in messages][-1]

    bad, good, short = seen(0, -1, -0.9), seen(0, 1, 0.9), seen(0, 0, 0.1, dull=True)
    assert fires(bad, bad, bad) == ["negative_streak"]
    assert fires(good, good, good) == ["positive_window"]
    assert fires(good, good, good, seen(100, -1, -0.8)) == ["emotion_shift"]
    assert fires(good, good, good, seen(181, -1, -0.8)) == []
    assert fires(good, good, good, seen(100, -1, -0.8, sure=0.5)) == []
    assert fires(good, good, good, seen(100, -1, -0.8, boundary=True)) == []
    assert fires(short, short, short) == ["perfunctory"]
    assert fires(short, short, seen(0, 0, 0.1, dull=True, strong=False)) == ["perfunctory"]
    assert fires(short, seen(0, 0, 0.1, dull=True, strong=False), seen(0, 0, 0.1, dull=True, strong=False)) == []
    quiet = [seen(t, 0, 0.0) for t in (0, 10, 20, 500)]
    assert fires(*quiet) == ["topic_cooling"]
    assert fires(*quiet[:3], seen(500, 0, 0.0, substantive=True)) == []
    assert fires(*(seen(t, 0, 0.0) for t in range(5)), seen(400, 0, 0.0, substantive=True), seen(450, 0, 0.0)) == []
    assert fires(*quiet[:3], seen(621, 0, 0.0)) == []


def test_pauses():
    tracker = triggers.Tracker()
    got = [tracker.take((i, 30 * i, -1, -0.9, 1.0, False, False, False, True)) for i in range(8)]
    assert [i for i, g in enumerate(got) if g] == [2, 6]
    assert len(tracker.window) == triggers.WINDOW
    assert triggers.Tracker.read(tracker.write()) == tracker


def test_words_of_live_messages(spark):
    from parley.functions import intents

    texts = ["我就不去了", "算了", "我算了一下", "你和他去吧", "不了谢谢", "随便你", "图片", " 嗯 嗯 ", "好的", "好吃吗", "OK", "嗯", "ok2", "今天要考试", "a1234", "ab", "一二三四五，六", "一二三四五六七八九十", "", None]
    f = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    got = {r[0]: tuple(r[1:]) for r in f.select(c, intents.interaction_intent(c), intents.substantive(c), intents.acknowledges(c), intents.acknowledges_strongly(c)).collect()}
    assert {t for t, g in got.items() if g[0] == "decline"} == {"我就不去了", "算了", "你和他去吧", "不了谢谢"}
    assert {t for t, g in got.items() if g[0] == "impatience"} == {"随便你"}
    assert {t for t, g in got.items() if g[1]} == {"好吃吗", "今天要考试", "a1234", "一二三四五，六", "一二三四五六七八九十"}
    assert {t for t, g in got.items() if g[2]} == {" 嗯 嗯 ", "好的", "OK", "嗯"}
    assert {t for t, g in got.items() if g[3]} == {" 嗯 嗯 ", "好的", "OK", "嗯"}


def test_repeated_captures_and_sessions(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    schema = "conversation_id long, hash string, ts timestamp"
    spark.createDataFrame([(1, "a", at(0)), (1, "a", at(5)), (1, "b", at(60)), (1, "c", at(9000)), (2, "z", at(10 * 86_400))], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert run(spark, tmp_path, triggers.deduplicated(read(), ["conversation_id", "hash"]), "dedup").count() == 4
    closed = run(spark, tmp_path, triggers.sessions_stream(read()), "sessions")
    assert sorted((r.conversation_id, r.n) for r in closed.where(F.col("conversation_id") == 1).collect()) == [(1, 1), (1, 3)]
