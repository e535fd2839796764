"""Chapters, their changes and spans, by loops over the weeks."""

import math

import numpy as np

from parley.operators import chapters as C
from parley.operators import segmentation
from parley.plans import search


def test_chapters_of_the_year(spark):
    at = "/root/testdata/sf0.01"
    m, moods = search.seasons(spark, at)
    rows = C.weekly_features(m, moods).orderBy("conversation_id", "week").collect()
    found = {(r.conversation_id, r.chapter): r for r in C.chapters(C.weekly_features(m, moods)).collect()}
    weeks = {}
    for r in rows:
        weeks.setdefault(r.conversation_id, []).append(r)
    want = 0
    for key, own in weeks.items():
        if len(own) < C.LEAST_WEEKS:
            assert not any(k[0] == key for k in found)
            continue
        table = [[w[f] for f in C.FEATURES] for w in own]
        edges = [0, *segmentation.best_cuts(np.array(table)), len(own)]
        mean = lambda part, i: sum(r[i] for r in part) / len(part)
        deviation = [math.sqrt(mean([[(r[i] - mean(table, i)) ** 2] for r in table], 0)) for i in range(4)]
        for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            r = found[key, n]
            assert (r.first_week, r.last_week, r.weeks, r.n) == (own[a].week, own[b - 1].week, b - a, sum(w.n for w in own[a:b]))
            assert (r.from_sec, r.to_sec) == (min(w.first_sec for w in own[a:b] if w.n), max(w.last_sec for w in own[a:b] if w.n))
            deltas = {f: (mean(table[a:b], i) - mean(table[edges[n - 1] : a], i)) / deviation[i] for i, f in enumerate(C.FEATURES)} if n else {}
            assert {x.feature: x.delta for x in r.changes} == {f: round(d, 2) for f, d in deltas.items() if abs(d) >= 0.5}
        want += len(edges) - 2
    assert want >= 2  # cuts are made
    spans = C.spans(C.chapters(C.weekly_features(m, moods)), m).collect()
    assert {r.conversation_id for r in spans} == set(weeks) and any(r.whole for r in spans) and len(spans) == len(found) + sum(len(w) < C.LEAST_WEEKS for w in weeks.values())


def test_empty_weeks(spark):
    day = lambda n: 1_704_067_200 + n * 86_400
    rows = [(1, i, day(d), d % 2, 1, "x") for i, d in enumerate([0, 0, 1, 30, 31])]
    m = spark.createDataFrame(rows, "conversation_id long, id long, ts_sec long, is_sender int, message_type int, content string")
    m = m.withColumn("ts", C.F.timestamp_seconds("ts_sec").cast("timestamp_ntz"))
    moods = spark.createDataFrame([(0, 1), (1, -1), (2, 0)], "message_id long, polarity int")
    got = C.weekly_features(m, moods).orderBy("week").collect()
    assert [r.n for r in got] == [3, 0, 0, 0, 2]
    assert [round(r.volume, 4) for r in got] == [round(math.log1p(n), 4) for n in (3, 0, 0, 0, 2)]
    assert [round(r.other_share, 4) for r in got] == [0.6667, 0.5, 0.5, 0.5, 0.5] and {r.pos_ratio for r in got} == {0.5}
    assert C.chapters(C.weekly_features(m, moods)).collect() == []
