"""Attribution of suggestions against a loop, and streams against the batch."""

import datetime
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from parley.streaming import attribution

SUGGESTIONS = "suggestion_id long, conversation_id long, created_sec long, now_sec long, speeches array<string>, created timestamp"
MESSAGES = "conversation_id long, id long, ts_sec long, sender string, content string, ts timestamp"


def at(seconds):
    return datetime.datetime.fromtimestamp(seconds, datetime.UTC)


def loop(suggestion, messages):
    _, conversation, created, now, speeches = suggestion[:5]
    until = min(created + 600, now) if now is not None else created + 600
    seen = sorted((t, i, s, (c or "").strip()) for v, i, t, s, c in messages if v == conversation and created <= t <= until and (c or "").strip())
    own, others = [m for m in seen if m[2] == "self"], [m for m in seen if m[2] not in ("self", "system")]
    age = 10**9 if now is None else now - created
    if others and (not own or others[0][0] < own[0][0]):
        return "interrupted", 0.45
    if not own:
        return ("pending", None) if age < 600 else ("low_confidence", 0.0)
    preface = lambda x: len(x) <= 8 or x.startswith(attribution.PREFACES)
    if len(own) == 1 and preface(own[0][3]) and age < 600:
        return "pending", None
    groups = [[own[0]]]
    for m in own[1:]:
        groups[-1].append(m) if m[0] - groups[-1][-1][0] <= 90 else groups.append([m])
    announced = len(own) >= 2 and preface(own[0][3])
    final = own[-1][3] if announced else " ".join(m[3] for m in groups[-1])
    like = round(max([SequenceMatcher(None, final, s).ratio() for s in speeches or []], default=0.0), 4)
    if announced:
        return "preface_then_reply", max(0.7, like)
    if like >= 0.9:
        return "accepted", like
    if like >= 0.35:
        return "rewritten", like
    return ("pending", None) if age < 180 else ("unrelated", like)


def cases():
    pick = random.Random(3)
    texts = ["shall we meet at the station tonight", "I would rather stay at home today", "对了 something else entirely here", "ok", "zzzz qqqq xxxx vvvv", " ", None, "shall we meet at a station"]
    messages, suggestions, t = [], [], 1_700_000_000
    for i in range(700):
        t += pick.choice((0, 5, 30, 89, 90, 91, 200, 400, 599, 600, 601, 1_300))
        messages.append((i % 2, i, t, pick.choice(("self", "self", "friend", "system", "other")), pick.choice(texts)))
        if pick.random() < 0.3:
            created = t + pick.choice((0, 1, -5))
            suggestions.append((i, i % 2, created, pick.choice((None, created + 100, created + 179, created + 180, created + 599, created + 600)), pick.choice(([texts[0], texts[1]], [], None, [texts[7]]))))
    return suggestions, messages


@pytest.fixture(scope="module")
def frames(spark):
    suggestions, messages = cases()
    return spark.createDataFrame([(*s, at(s[2])) for s in suggestions], SUGGESTIONS), spark.createDataFrame([(*m, at(m[2])) for m in messages], MESSAGES)


def test_batch_is_the_loop(frames):
    suggestions, messages = cases()
    found = {r.suggestion_id: (r.outcome, r.confidence) for r in attribution.attributions(*frames).collect()}
    assert found == {s[0]: loop(s, messages) for s in suggestions}
    assert {o for o, _ in found.values()} == {"interrupted", "low_confidence", "preface_then_reply", "accepted", "rewritten", "unrelated", "pending"}


def test_hand_worked(spark):
    messages = [(1, 1, 1_000, "self", "hm"), (1, 2, 1_050, "self", "let us go by train"), (2, 3, 1_000, "self", "let us"), (2, 4, 1_090, "self", "go by train"), (3, 5, 1_000, "friend", "no"), (3, 6, 1_000, "self", "let us go by train")]
    suggestions = [(i, i, 990, None, ["by car", "let us go by train"], at(990)) for i in (1, 2, 3, 4)]
    frames = spark.createDataFrame(suggestions, SUGGESTIONS), spark.createDataFrame([(*m, at(m[2])) for m in messages], MESSAGES)
    found = {r.suggestion_id: tuple(r[2:]) for r in attribution.attributions(*frames).collect()}
    assert found == {
        1: ("preface_then_reply", 1.0, "let us go by train", "let us go by train"), 2: ("preface_then_reply", 0.7586, "let us go by train", "go by train"),
        3: ("accepted", 1.0, "let us go by train", "let us go by train"), 4: ("low_confidence", 0.0, None, None),
    }


def test_stream_is_the_batch_when_all_windows_are_over(spark, frames, tmp_path):
    suggestions, messages = (f.where("ts_sec is not null" if "ts_sec" in f.columns else "true") for f in frames)
    last = 1_900_000_000
    end = spark.createDataFrame([(9, -1, last, "friend", "the end", at(last))], MESSAGES), spark.createDataFrame([(-1, 9, last, None, [], at(last))], SUGGESTIONS)
    for step in range(2):  # half of the time each, then a row that moves both watermarks
        for name, frame, column in (("s", suggestions, "created_sec"), ("m", messages, "ts_sec")):
            middle = 1_700_000_000 + 60_000
            frame.where(f"{column} {'<' if step == 0 else '>='} {middle}").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    end[0].coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    end[1].coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    read = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
    out = attribution.attributions_stream(read("s", SUGGESTIONS), read("m", MESSAGES), "2 days")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    got = {r.suggestion_id: tuple(r[2:]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.suggestion_id: tuple(r[2:]) for r in attribution.attributions(suggestions.withColumn("now_sec", F.lit(None).cast("long")), messages).collect()}
    assert got == want and len(got) > 100
