"""The log as a stream over restarts, and captures of a screen that shows equal messages."""

import json
import random

import pytest

from parley.sources import feed
from parley.streaming.triggers import needs_rocksdb
from test_streaming import run


def lines(a, b):
    return "".join(json.dumps({"conversation_id": i % 3, "id": i, "ts_sec": 1_000 + i, "content": f"message {i} é\n" + "x" * (i % 50)}) + "\n" for i in range(a, b))


def drain(spark, folder, tmp_path):
    query = feed.message_log(spark, folder).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return sorted(r.id for r in spark.read.schema(feed.MESSAGE).parquet(str(tmp_path / "out")).collect())


def test_restarts_neither_repeat_nor_lose_a_line(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.jsonl").write_text(lines(0, 40))
    assert drain(spark, str(folder), tmp_path) == list(range(40))
    text = lines(40, 60)
    with (folder / "a.jsonl").open("a") as f:
        f.write(text[:-7])  # the last line isn't complete yet
    (folder / "b.jsonl").write_text(lines(100, 103))
    (folder / "ignored.txt").write_text("no line")
    assert drain(spark, str(folder), tmp_path) == [*range(59), 100, 101, 102]
    assert drain(spark, str(folder), tmp_path) == [*range(59), 100, 101, 102]
    with (folder / "a.jsonl").open("a") as f:
        f.write(text[-7:])
    assert drain(spark, str(folder), tmp_path) == [*range(60), 100, 101, 102]


@pytest.mark.parametrize("part", [1, 30, 64, 100, 10_000])
def test_parts_hold_each_line_once(spark, tmp_path, part):
    (tmp_path / "a.jsonl").write_text(lines(0, 30))
    schema = spark.createDataFrame([], feed.MESSAGE).schema
    reader = feed.LogReader(schema, {"path": str(tmp_path), "part": str(part)})
    end = reader.latestOffset()
    rows = [r for p in reader.partitions({}, end) for r in reader.read(p)]
    assert [r[1] for r in rows] == list(range(30)) and rows[3][3].startswith("message 3 é\n")
    assert feed.LogReader(schema, {"path": f"file://{tmp_path}"}).latestOffset() == end
    assert feed.LogReader(schema, {"path": str(tmp_path / "none")}).latestOffset() == {}


def captures():
    pick, rows, i = random.Random(2), [], 0
    for poll in range(6):
        for _ in range(60):
            rows.append((poll, pick.randrange(2), 1_000 + poll + pick.randrange(3), pick.choice("ab"), i))
            i += 1
    return rows


def test_occurrences_in_batch_and_stream(spark, tmp_path):
    needs_rocksdb(spark)
    rows, schema = captures(), "poll long, conversation_id long, ts_sec long, content string, id long"
    seen, want = {}, set()
    for poll in range(6):
        now = {}
        for r in (r for r in rows if r[0] == poll):
            n = now[r[1:4]] = now.get(r[1:4], 0) + 1
            if n > seen.get(r[1:4], 0):
                want.add((poll, *r[1:4], r[4], n))
        seen |= {k: max(n, seen.get(k, 0)) for k, n in now.items()}
    batch = feed.occurrences(spark.createDataFrame(rows, schema))
    assert {tuple(r)[:6] for r in batch.collect()} == want
    for poll in range(0, 6, 3):
        spark.createDataFrame([r for r in rows if poll <= r[0] < poll + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feed.occurrences_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    got = run(spark, tmp_path, stream, "out", len(rows)).collect()
    assert {tuple(r)[:6] for r in got} == want and {r.hash for r in got} == {r.hash for r in batch.collect()}
