"""Topic segments against a fold over each conversation's messages."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from parley.operators import topics as T

STOP = ("then",)


def tokens(text):
    compact = re.sub(r"\s+", "", text)
    words = [w for w in re.split(r"[\s,，。！？；：、/()（）\[\]\-~～]+", text) if len(w) >= 2]
    for n in (2, 3, 4):
        words += [compact[i : i + n] for i in range(len(compact) - n + 1)]
    return list(dict.fromkeys(words))[:80]


def told(messages):
    return {t for t in [x for x in tokens(" ".join(m[3] for m in messages)) if x not in STOP][:8]}


def share(a, b):
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def segments(messages):
    """(topic, part, ids) of one conversation's (id, ts, ts_sec, content), message by message."""
    rows = sorted(((i, ts, s, re.sub(r"\s+", " ", c or "").strip()[:240]) for i, ts, s, c in messages), key=lambda m: (m[2], m[0]))
    rows = [m for m in rows if m[3]]
    found = []
    for m in rows:
        cut = not found
        if found:
            open_, p = found[-1], found[-1][-1]
            gap, a, b = m[2] - p[2], told(found[-1][-6:]), told([m])
            if gap > 0:
                cut = p[1].date() != m[1].date() or p[1].hour < 7 <= m[1].hour or gap > 7200 or (gap > 1800 and share(a, b) <= 0.1) or (gap >= 300 and len(open_) >= 10 and bool(a and b) and not a & b)
        found.append([m]) if cut else found[-1].append(m)
    merged, i = [], 0
    while i < len(found):
        now = found[i]
        if len(now) < 3 and i + 1 < len(found) and found[i + 1][0][2] - now[-1][2] <= 1800:
            merged.append(now + found[i + 1])
            i += 2
        elif len(now) < 3 and merged and now[0][2] - merged[-1][-1][2] <= 1800:
            merged[-1] = merged[-1] + now
            i += 1
        else:
            merged.append(now)
            i += 1
    out = []
    for topic, s in enumerate(merged):
        if len(s) <= 40 and sum(len(m[3]) for m in s) <= 3000:
            out.append((topic, 0, [m[0] for m in s]))
            continue
        part = 0
        while True:
            out.append((topic, part, [m[0] for m in s[28 * part : 28 * part + 32]]))
            if 28 * part + 32 >= len(s):
                break
            part += 1
    return out


def chats():
    pick, rows, i = random.Random(7), [], 0
    words = ["tea house", "train", "exam", "football match", "then", "猫和狗", "a", "see you then"]
    for c in range(6):
        t = 1_700_000_000 + 977 * c
        for _ in range(500):
            t += pick.choice((0, 0, 5, 30, 60, 299, 300, 301, 900, 1800, 1801, 2500, 7200, 7201, 20_000) if c % 2 else (1, 20, 300, 400, 500, 700, 1801))
            if c >= 4:
                t -= pick.choice((0, 0, 0, 250))  # hardly a pause
            text = pick.choice((None, "", "  \n", *words * 4, "long " * pick.choice((3, 100))))
            rows.append((c, i, datetime.datetime.fromtimestamp(t, datetime.UTC).replace(tzinfo=None), t, text))
            i += 1
    rows += [(9, i + k, datetime.datetime(2024, 1, 1, 12), 1_704_110_400, "one second") for k in range(100)]  # ties
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(chats(), "conversation_id long, id long, ts timestamp_ntz, ts_sec long, content string")


def test_segments_of_chats_and_their_windows(frame):
    found = {}
    for r in T.topic_rows(frame.repartition(7), STOP).collect():
        found.setdefault((r.conversation_id, r.topic, r.part), []).append((r.ts_sec, r.id))
    expected = {}
    for c in {r[0] for r in chats()}:
        for topic, part, ids in segments([r[1:] for r in chats() if r[0] == c]):
            expected[c, topic, part] = ids
    assert {k: [i for _, i in sorted(v)] for k, v in found.items()} == expected
    assert sum(k[2] > 0 for k in expected) >= 3 and len(expected) > 200


def test_summary(frame):
    rows = T.topic_rows(frame, STOP)
    assert T.topic_segments(frame, STOP).agg(F.sum("n")).first()[0] == rows.count()
    assert T.topic_segments(frame.limit(0)).collect() == []


def test_tokens_are_those_of_the_definition(spark):
    texts = ["a bc  def", "", "哈哈哈哈", "x" * 500, "一二三,四五（六七）-八九", " abc\tab "]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "x string").select(T.topic_tokens(F.col("x")).alias("t")).collect()]
    assert got == [tokens(t) for t in texts]


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_on_events(spark, sf):
    from parley.plans import search

    at = f"/root/testdata/{sf}"
    m = search.spoken(spark, at).select("conversation_id", "id", "ts", "ts_sec", "content").collect()
    expected = set()
    for c in {r[0] for r in m}:
        own = {r[1]: r for r in m if r[0] == c}
        for topic, part, ids in segments([tuple(r)[1:] for r in own.values()]):
            expected.add((c, topic, part, own[ids[0]][3], own[ids[-1]][3], len(ids), ids[0], ids[-1]))
    got = {(r.conversation_id, r.topic, r.part, r.start_sec, r.end_sec, r.n, r.first_id, r.last_id) for r in search.topic_query(spark, at).collect()}
    assert got == expected


def test_masks_are_found_once(spark, capsys):
    rows = [(1, i, datetime.datetime(2024, 1, 1, 10, i), 1_704_103_200 + 60 * i, f"word {i}") for i in range(9)]
    found = T.topic_segments(spark.createDataFrame(rows, "conversation_id long, id long, ts timestamp_ntz, ts_sec long, content string"))
    found.explain()
    assert "MapInPandas" not in capsys.readouterr().out
    assert [(r.n, r.first_id, r.last_id) for r in found.collect()] == [(9, 0, 8)]
