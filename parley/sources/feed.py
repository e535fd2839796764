"""A growing message log as a stream: append-only files of JSON lines, read up to a frontier.

At each poll the frontier is where the last complete line of every file ends; a batch is what lies between two frontiers, by
file and byte. Both are offsets that Spark keeps in its checkpoint, so that a restart neither repeats nor loses a line, and a
poll at which nothing has grown makes no batch. Files are reached through Arrow's file systems, which know more than local
paths; a long stretch of one file is cut into parts, each of which begins with the first line that starts in it.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Bytes of a file that one task reads, and that are looked through at a time for the last line's end.
PART, BLOCK = 64 << 20, 1 << 16
MESSAGE = "conversation_id long, id long, ts_sec long, content string"


@dataclass
class Stretch(InputPartition):
    """Bytes ``[start, end)`` of a file; ``whole`` says whether ``start`` is where a line begins."""

    path: str
    start: int
    end: int
    whole: bool


def _last_line_end(store: fs.FileSystem, path: str, size: int, known: int) -> int:
    """Where the last complete line up to ``size`` ends, at least ``known``."""
    with store.open_input_file(path) as f:
        at = size
        while at > known:
            start = max(known, at - BLOCK)
            found = f.read_at(at - start, start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return known


class LogReader(DataSourceStreamReader):
    """Offsets are ``{file name: bytes read}``."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.fields = [f.name for f in schema.fields]
        self.uri, self.part = options["path"], int(options.get("part", PART))

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (fs.LocalFileSystem(), self.uri)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        store, folder = self._store()
        files = [i for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.is_file and i.base_name.endswith(".jsonl")]
        seen = getattr(self, "_seen", {})
        self._seen = {i.base_name: _last_line_end(store, i.path, i.size, seen.get(i.base_name, 0)) for i in sorted(files, key=lambda i: i.base_name)}
        return {k: v for k, v in self._seen.items() if v}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        _, folder = self._store()
        out = []
        for name, to in end.items():
            first = start.get(name, 0)
            out += [Stretch(f"{folder}/{name}", at, min(at + self.part, to), at == first) for at in range(first, to, self.part)]
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        store, _ = self._store()
        with store.open_input_file(partition.path) as raw:
            # the line that a part begins within belongs to the part before, unless it begins just here
            at = partition.start if partition.whole else partition.start - 1
            raw.seek(at)
            lines = io.BufferedReader(raw, BLOCK)
            if not partition.whole:
                at += len(lines.readline())
            while at < partition.end and (line := lines.readline()):
                at += len(line)
                row = json.loads(line)
                yield tuple(row.get(c) for c in self.fields)

    def commit(self, end: dict) -> None:
        pass


class MessageLog(DataSource):
    """``spark.readStream.format("message_log").schema(...).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return MESSAGE

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return LogReader(schema, dict(self.options))


def message_log(spark: SparkSession, folder: str, schema: str = MESSAGE) -> DataFrame:
    """The log as a stream of rows; lines that lack a column have a null there."""
    spark.dataSource.register(MessageLog)
    return spark.readStream.format("message_log").schema(schema).load(folder)


#: What captures of a screen are the same message by: conversation, shown time and content.
SAME = ["conversation_id", "ts_sec", "content"]


def occurrences(captures: DataFrame) -> DataFrame:
    """``captures(poll, conversation_id, ts_sec, content, id)`` as new messages: with ``occurrence`` and ``hash``, each once, by its first poll.

    Equal messages of one time are told apart by their number within a poll: where a poll shows three and those before showed two at most, the
    third one is new.
    """
    place = F.row_number().over(Window.partitionBy("poll", *SAME).orderBy("id"))
    numbered = captures.withColumn("occurrence", place)
    first = numbered.groupBy(*SAME, "occurrence").agg(F.min(F.struct("poll", "id")).alias("_f"))
    return first.select("_f.poll", "conversation_id", "ts_sec", "content", "_f.id", "occurrence", message_hash().alias("hash"))


def message_hash() -> Column:
    return F.md5(F.concat_ws("|", F.col("conversation_id").cast("string"), F.col("ts_sec").cast("string"), "content", F.col("occurrence").cast("string")))


class _Counter(StatefulProcessor):
    """How many equal messages a poll has shown at most, per message; forgotten after a while without one."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        import pandas as pd

        seen = self.seen.get()[0] if self.seen.exists() else 0
        new = []
        for poll, own in pd.concat(list(rows)).sort_values(["poll", "id"]).groupby("poll", sort=True):
            new += [(int(poll), *key, int(i), n) for n, i in enumerate(own["id"].tolist(), 1) if n > seen]
            seen = max(seen, len(own))
        self.seen.update((seen,))
        yield pd.DataFrame(new, columns=["poll", *SAME, "id", "occurrence"]).astype({"poll": "int64", "conversation_id": "int64", "ts_sec": "int64", "id": "int64", "occurrence": "int32"})

    def close(self) -> None:
        pass


def occurrences_stream(captures: DataFrame, remembered_seconds: int = 86_400) -> DataFrame:
    """The same over a stream of captures, polls in order; state lasts for a time after a message was last shown. It needs state in RocksDB."""
    out = "poll long, conversation_id long, ts_sec long, content string, id long, occurrence int"
    found = captures.select("poll", *SAME, "id").groupBy(*SAME).transformWithStateInPandas(_Counter(remembered_seconds * 1_000), out, "Append", "ProcessingTime")
    return found.withColumn("hash", message_hash())
