"""Engagement and scores on small conversations, worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from parley.operators import dimensions, engagement

SCHEMA = "id long, conversation_id long, member long, ts timestamp, ts_sec long, is_sender int, message_type int, content string"
START = datetime.datetime(2024, 3, 4)


def chat(spark, rows, conversation=1):
    """rows: (hours after the start, side, text[, type])."""
    out = []
    for i, (hours, side, text, *kind) in enumerate(rows):
        at = START + datetime.timedelta(seconds=round(hours * 3600))
        out.append((i, conversation, 0, at, int((at - datetime.datetime(1970, 1, 1)).total_seconds()), side, kind[0] if kind else 1, text))
    return spark.createDataFrame(out, SCHEMA)


ROWS = [
    (8, 0, "早安"), (8.1, 0, "早上好呀"), (8.2, 0, "我们今天去吗"), (10.5, 1, "嗯"), (10.6, 1, "我觉得可以去看看"), (10.7, 1, "哈哈"), (10.8, 0, "好的"),
    (22, 1, "晚安"), (22.1, 0, "晚安晚安晚安晚安晚安"), (33, 0, " "), (56, 1, "早"), (57, 0, None), (58, 1, "你撤回了一条消息", 10_000), (58.1, 1, "小明撤回了一条新消息", 10_000), (58.2, 1, "你好", 10_000),
]


def test_engagement(spark):
    r = engagement.engagement(chat(spark, ROWS)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.n_texts, r.days, r.texts_self, r.texts_other) == (10, 2, 5, 5)
    assert (r.bursts_other, r.bursts_self) == (1, 1)  # 8:00 to 8:12, and 10:30 to 10:42
    # 8:12 to 10:30 and 10:48 to 22:00 by day, ended by one's own side; 22:06 to 8:00 two days later is more than a day
    assert (r.long_unanswered_self, r.long_unanswered_other, r.ice_breaks_self, r.ice_breaks_other) == (2, 0, 1, 0)
    assert (r.mornings_other, r.mornings_self, r.nights_self, r.nights_other) == (1, 1, 1, 0)  # two on one day are one; ten characters are no greeting
    assert (r.togetherness_other, r.togetherness_self) == (1.0, 0.0)
    assert (r.perfunctory_self, r.perfunctory_other) == (0.6, 0.2)  # 嗯, 晚安 and 早 by shortness; 哈哈 and 好的 are warm; 早安 is short
    assert r.variation == pytest.approx(0.8)


def test_recalls_and_no_rows(spark):
    m = chat(spark, ROWS)
    assert [(r.mine, r.theirs) for r in engagement.recalls(m).collect()] == [(1, 1)]
    none = m.where("false")
    assert engagement.engagement(none).count() == engagement.recalls(none).count() == engagement.cooling(none).count() == 0
    assert dimensions.risk_signals(none).count() == 0


@pytest.mark.parametrize(("start", "end", "want"), [(1, 3, True), (6, 9, False), (5.9, 8.5, True), (2, 2.9, False), (1.9, 2.0, False), (1.9, 2.01, True), (8, 8 + 241, True)])
def test_deep_night(spark, start, end, want):
    df = spark.createDataFrame([(int(start * 3600) + 86_400, int(end * 3600) + 86_400)], "a long, b long")
    assert df.select(engagement.spans_deep_night(F.col("a"), F.col("b"))).first()[0] is want


def test_risk_levels(spark):
    """Eight days that fade from 12 texts to 1, all begun by one's own side in bursts."""
    rows = [(24 * d + 9 + 0.01 * k, 1, f"message {k} of day {d}") for d, n in enumerate((12, 12, 12, 6, 6, 3, 2, 1)) for k in range(n)]
    m = chat(spark, rows)
    got = dimensions.risk_signals(m).first()
    assert (got.hot_cold, got.one_sided, got.denial, got.warm_then_cold, got.highest) == ("normal", "normal", "normal", "watch", "watch")
    evidence = spark.createDataFrame([(1, False, True, None, True)], "conversation_id long, hot_cold boolean, one_sided boolean, denial boolean, warm_then_cold boolean")
    got = dimensions.risk_signals(m, evidence).first()
    assert (got.one_sided, got.denial, got.warm_then_cold, got.highest) == ("watch", "normal", "alert", "alert")


def test_overall(spark):
    stats = spark.createDataFrame([(1, 400, 30, 30, 12), (2, 400, 30, 30, 12), (3, 0, 0, 0, 0)], "conversation_id long, n long, chat_days long, sessions long, sessions_other long")
    scores = spark.createDataFrame([(1, 80.0, 60.0), (2, 90.0, None), (3, 90.0, 90.0)], "conversation_id long, investment double, closeness double")
    got = {r.conversation_id: (r.overall, r.band) for r in dimensions.overall(scores, stats).collect()}
    assert got == {1: (74.55, "high"), 2: (90.0, "very high"), 3: (35.0, "moderate")}


def test_investment(spark):
    rows = [(0.01 * k, k % 2, "x" * 20) for k in range(40)]
    vectors = spark.createDataFrame([(k, [1.0, 0.0] if k % 2 else [1.0, 1.0]) for k in range(40)], "vec_id long, embedding array<double>")
    r = dimensions.investment(chat(spark, rows), vectors).first()
    assert (r.timely, r.initiation, r.unanswered, r.bursts, r.long_bonus) == (100.0, 100.0, 100.0, 60.0, 0.0)
    assert r.daily == 100.0 and r.continuity == 100.0 and r.symmetry == pytest.approx(75.0)
    sure = (0.55 / 20 + 0.45 / 25) ** 1.5
    assert r.investment == pytest.approx((10 + 20 + 20 + 20 + 7.5 + 10 + 6) * sure + 38 * (1 - sure))


def test_preference(spark):
    rows = [(8, 1, "Tea or coffee"), (8.1, 0, "TEA please"), (8.2, 1, "fine"), (12, 0, "hello"), (12.1, 1, "hi"), (20, 1, "late"), (20.1, 0, None)]
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0])], "vec_id long, embedding array<double>")
    r = dimensions.preference(chat(spark, rows), vectors, ("tea",)).collect()
    # one session of three; the pairs that begin in it: units 0-1 (1.0), 1-2 (0.0) and 2-3 (0.7071)
    assert [tuple(x)[1:] for x in r] == [(3, 1, 100.0, 56.9, 74.14)]
    r = dimensions.preference(chat(spark, rows), vectors, ()).first()
    assert (r.sessions, r.matched, r.mention, r.continuity, r.preference) == (3, 0, None, None, None)
    assert dimensions.preference(chat(spark, rows), vectors, ("coffee|tea",)).first().matched == 0  # words, not patterns


def test_initiative_bands(spark):
    from parley.operators.balance import initiative_bands

    counts = {1: (4, 4), 2: (20, 10), 3: (20, 14), 4: (20, 16), 5: (100, 62), 6: (100, 20), 7: (100, 35)}
    rows = [(c, 0 if i < theirs else 1) for c, (n, theirs) in counts.items() for i in range(n)]
    got = {r.conversation_id: r.band for r in initiative_bands(spark.createDataFrame(rows, "conversation_id long, initiator int")).collect()}
    assert got == {1: "insufficient", 2: "balanced", 3: "balanced", 4: "other dominant", 5: "other leans", 6: "self dominant", 7: "self leans"}


def test_resonance_of_a_pair(spark):
    from parley.operators import resonance as R

    rows = [(8, 1, "great"), (8.05, 0, "yes"), (8.2, 1, "bad"), (8.3, 0, "哈哈")]
    moods = spark.createDataFrame([(0, 0.8), (1, 0.5), (2, -0.6), (3, 0.1)], "message_id long, intensity double")
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    pairs = {(r.prev_unit_id, r.unit_id): r for r in R.mood_pairs(chat(spark, rows), moods, none).withColumn("answer", R.positive_response()).collect()}
    answers = sorted(round(r.answer, 4) for r in pairs.values())
    assert answers == [0.0, 0.25, 1.0]  # a negative reply; a soft word after six minutes; 0.86 and 0.06 for 0.5 and 0.08 for three minutes
    r = R.resonance(chat(spark, rows), moods, none).collect()
    assert len(r) == 1 and 0 <= r[0].resonance <= 100 and r[0].valence == 80.0
