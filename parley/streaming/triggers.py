"""Triggers over the peer's last messages, one rule set for streams and for batches.

State per conversation is a window of the last five messages, counts by second of the last ten minutes and the last
firing time of each trigger, so its size doesn't grow with the stream; silence is a timer. In a batch every message's
own window is a column, found per day with carried rows, counts come from windows within cells of time, and only the
pauses are sequential: a trigger's candidates fall apart wherever none follows within its pause, and each such island is
folded by itself. What a message's words say is a column in both (:func:`marked`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.functions.intents import acknowledges, acknowledges_strongly, interaction_intent, substantive
from parley.functions.lexicon import LIVE, Cues
from parley.operators import timeline

#: Messages in the window, each trigger's pause in seconds before it fires again, and how grave it is.
WINDOW = 5
PAUSES = {"negative_streak": 120, "emotion_shift": 180, "perfunctory": 300, "positive_window": 300, "topic_cooling": 300, "silence": 600}
SEVERITIES = {"negative_streak": "high", "emotion_shift": "high", "perfunctory": "medium", "positive_window": "low", "topic_cooling": "medium", "silence": "medium"}
TEXT = 1


@dataclass(frozen=True)
class Rules:
    """Limits of the triggers, one after the other: a sure fall from three messages of which two are positive; three short calm words of
    consent close together, of which two are strong; three happy messages; a drop of messages between two spans of equal length, unless
    one of the last two moves the talk on; a silence."""

    least_good: int = 2
    least_mood: float = 0.45
    least_level: float = 0.25
    most_low: float = -0.5
    least_sure: float = 0.6
    drop: float = 0.7
    shift_span: int = 180
    short: int = 4
    calm: float = 0.25
    dull_span: int = 180
    least_strong: int = 2
    happy: float = 0.5
    span: int = 300
    least_before: int = 2
    least_counted: int = 4
    cooled: float = 0.5
    signal_messages: int = 2
    signal_age: int = 120
    silence: int = 600
    pauses: dict[str, int] = field(default_factory=lambda: dict(PAUSES))


RULES = Rules()
#: How late rows may be.
LATENESS = "24 hours"
#: What a message brings besides its conversation: place and time, mood, and what its words do.
SEEN = ("id", "ts_sec", "polarity", "intensity", "confidence", "boundary", "dull", "strong", "substantive")
FIRED = "conversation_id long, id long, ts_sec long, trigger string, severity string, level double"


def marked(messages: DataFrame, rules: Rules = RULES, cues: Cues = LIVE) -> DataFrame:
    """``messages(conversation_id, id, ts_sec, message_type, content, polarity, intensity, confidence)`` of the peer, with what their words do:
    ``boundary`` (declines or loses patience), ``dull`` (a calm word of consent), ``strong`` (one that ends a talk), ``substantive``."""
    content = F.col("content")
    calm = (F.col("message_type") == TEXT) & (F.col("polarity") == 0) & (F.abs("intensity") <= rules.calm)
    return messages.withColumns({
        "boundary": interaction_intent(content, cues).isNotNull(), "dull": calm & acknowledges(content, cues, rules.short),
        "strong": acknowledges_strongly(content, cues), "substantive": substantive(content, cues),
    })


@dataclass
class Tracker:
    """One conversation's state, which takes its messages in order."""

    window: list[list] = field(default_factory=list)
    counts: dict[int, int] = field(default_factory=dict)
    fired: dict[str, int] = field(default_factory=dict)
    #: Processing time in seconds since when nothing came; null before the first message and after a silence was told.
    since: float | None = None

    @classmethod
    def read(cls, text: str) -> Tracker:
        window, counts, fired, since = json.loads(text)
        return cls(window, {int(k): v for k, v in counts.items()}, fired, since)

    def write(self) -> str:
        return json.dumps([self.window, self.counts, self.fired, self.since])

    def met(self, rules: Rules) -> list[str]:
        """Triggers that the newest message sets off, whatever their pauses."""
        rows = [dict(zip(SEEN, w, strict=True)) for w in self.window]
        last, three, before = rows[-1], rows[-3:], rows[:-1][-3:]
        out = []
        if len(three) == 3 and all(w["polarity"] == -1 for w in three):
            out.append("negative_streak")
        elif len(before) == 3 and last["polarity"] == -1 and not last["boundary"] and last["confidence"] >= rules.least_sure and sum(w["polarity"] == 1 for w in before) >= rules.least_good:
            mean, mood = sum(w["intensity"] for w in before) / 3, sum(w["polarity"] for w in before) / 3
            fall = mean >= rules.least_level and last["intensity"] <= rules.most_low and mean - last["intensity"] >= rules.drop
            if mood >= rules.least_mood and fall and last["ts_sec"] - before[0]["ts_sec"] <= rules.shift_span:
                out.append("emotion_shift")
        if len(three) == 3 and all(w["dull"] and not w["boundary"] for w in three) and sum(w["strong"] for w in three) >= rules.least_strong and last["ts_sec"] - three[0]["ts_sec"] <= rules.dull_span:
            out.append("perfunctory")
        if len(three) == 3 and all(w["polarity"] == 1 and w["intensity"] > rules.happy for w in three):
            out.append("positive_window")
        now = sum(n for t, n in self.counts.items() if t > last["ts_sec"] - rules.span)
        earlier = sum(self.counts.values()) - now
        moves_on = last["boundary"] or any(w["substantive"] and last["ts_sec"] - w["ts_sec"] <= rules.signal_age for w in rows[-rules.signal_messages :])
        if now + earlier >= rules.least_counted and earlier >= rules.least_before and now < earlier * rules.cooled and not moves_on:
            out.append("topic_cooling")
        return out

    def take(self, row: tuple, rules: Rules = RULES, warming: bool = False) -> list[str]:
        """Takes a message in; what fires, without triggers in their pause. A warming message fills the state and fires nothing."""
        self.window = [*self.window, list(row)][-WINDOW:]
        ts = row[1]
        self.counts[ts] = self.counts.get(ts, 0) + 1
        self.counts = {t: n for t, n in self.counts.items() if t > ts - 2 * rules.span}
        out = []
        for name in [] if warming else self.met(rules):
            if name not in self.fired or ts - self.fired[name] >= rules.pauses[name]:
                self.fired[name] = ts
                out.append(name)
        return out


def _newest(n: int) -> Column:
    """The ``n`` newest rows of the array ``last``."""
    return F.slice("last", F.greatest(F.lit(1), F.size("last") - (n - 1)), F.lit(n))


def streak() -> Column:
    return (F.size("last") >= 3) & F.forall(_newest(3), lambda x: x["polarity"] == -1)


def shifts(rules: Rules = RULES) -> Column:
    """Whether the newest of at least four rows is a fall; the same sums in the same order as :meth:`Tracker.met`."""
    before = F.slice("last", F.greatest(F.lit(1), F.size("last") - 3), F.lit(3))
    total = lambda c: F.aggregate(before, F.lit(0.0), lambda a, x: a + x[c]) / 3
    now, first = F.element_at("last", -1), F.get(before, F.lit(0))
    sure = (now["polarity"] == -1) & ~now["boundary"] & (now["confidence"] >= rules.least_sure)
    good = F.size(F.filter(before, lambda x: x["polarity"] == 1)) >= rules.least_good
    fall = (total("intensity") >= rules.least_level) & (now["intensity"] <= rules.most_low) & (total("intensity") - now["intensity"] >= rules.drop)
    return (F.size("last") >= 4) & sure & good & (total("polarity") >= rules.least_mood) & fall & (now["ts_sec"] - first["ts_sec"] <= rules.shift_span)


def dull(rules: Rules = RULES) -> Column:
    close = F.element_at("last", -1)["ts_sec"] - F.get(_newest(3), F.lit(0))["ts_sec"] <= rules.dull_span
    strong = F.size(F.filter(_newest(3), lambda x: x["strong"])) >= rules.least_strong
    return (F.size("last") >= 3) & F.forall(_newest(3), lambda x: x["dull"] & ~x["boundary"]) & strong & close


def happy(rules: Rules = RULES) -> Column:
    return (F.size("last") >= 3) & F.forall(_newest(3), lambda x: (x["polarity"] == 1) & (x["intensity"] > rules.happy))


def cools(rules: Rules = RULES) -> Column:
    """From the counts ``now`` and ``before`` of :func:`counted` and the last messages."""
    newest = F.element_at("last", -1)
    moves_on = newest["boundary"] | F.exists(_newest(rules.signal_messages), lambda x: x["substantive"] & (newest["ts_sec"] - x["ts_sec"] <= rules.signal_age))
    return (F.col("now") + F.col("before") >= rules.least_counted) & (F.col("before") >= rules.least_before) & (F.col("now") < F.col("before") * rules.cooled) & ~moves_on


def counted(rows: DataFrame, span: int = RULES.span) -> DataFrame:
    """``rows`` with how many messages of their conversation lie in the last ``span`` seconds up to each (``now``) and in those before (``before``).

    Windows run within cells of two spans that also get the rows of the cell before.
    """
    cell = (F.col("ts_sec") / (2 * span)).cast("long")
    spread = rows.withColumn("_cell", F.explode(F.array(cell, cell + 1)))
    own = Window.partitionBy("conversation_id", "_cell").orderBy("ts_sec")
    nth = F.row_number().over(Window.partitionBy("conversation_id", "_cell", "ts_sec").orderBy("id"))
    both = spread.withColumns({"now": F.count("*").over(own.rangeBetween(1 - span, -1)) + nth, "before": F.count("*").over(own.rangeBetween(1 - 2 * span, -span))})
    return both.where(F.col("_cell") == cell).drop("_cell")


def windows(messages: DataFrame, rules: Rules = RULES, counts: bool = True) -> DataFrame:
    """``messages`` of :func:`marked` with their window ``last`` and, if asked for, their counts ``now`` and ``before``."""
    rows = messages.withColumn("day", F.to_date(F.timestamp_seconds("ts_sec")))
    rows = counted(rows, rules.span) if counts else rows
    return timeline.with_last(rows, list(SEEN[1:]), WINDOW, order=("ts_sec", "id"))


def silences(messages: DataFrame, now_sec: int | None = None, rules: Rules = RULES) -> DataFrame:
    """``conversation_id, id, ts_sec`` where a silence is told: after each message that no other follows in time, up to ``now_sec``."""
    rows = messages.withColumn("day", F.to_date(F.timestamp_seconds("ts_sec")))
    ended = timeline.with_previous(rows, ["id", "ts_sec"], ["conversation_id"], ["ts_sec", "id"]).where(F.col("ts_sec") - F.col("prev_ts_sec") > rules.silence)
    ended = ended.select("conversation_id", F.col("prev_id").alias("id"), (F.col("prev_ts_sec") + rules.silence).alias("ts_sec"))
    last = messages.groupBy("conversation_id").agg(F.max(F.struct("ts_sec", "id")).alias("l")).select("conversation_id", F.col("l.id").alias("id"), (F.col("l.ts_sec") + rules.silence).alias("ts_sec"))
    return ended.unionByName(last if now_sec is None else last.where(F.col("ts_sec") < now_sec))


def _severity(trigger: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in SEVERITIES.items() for x in pair))[trigger]


def triggers_batch(messages: DataFrame, rules: Rules = RULES, now_sec: int | None = None) -> DataFrame:
    """``messages`` of :func:`marked` to the triggers that fire, silences included (see :func:`silences` for ``now_sec``)."""
    met = {"negative_streak": streak(), "emotion_shift": ~streak() & shifts(rules), "perfunctory": dull(rules), "positive_window": happy(rules), "topic_cooling": cools(rules)}
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in met.items())))
    found = windows(messages, rules).select("conversation_id", "id", "ts_sec", "day", "intensity", F.explode(names).alias("trigger"))
    pause = F.create_map(*(F.lit(x) for pair in rules.pauses.items() for x in pair))[F.col("trigger")]
    runs = timeline.with_runs(found, "run", ["ts_sec"], F.col("ts_sec") - F.col("prev_ts_sec") >= pause, ["conversation_id", "trigger"], ["ts_sec", "id"])
    islands = runs.groupBy("conversation_id", "trigger", "run").agg(F.array_sort(F.collect_list(F.struct("ts_sec", "id", F.col("intensity").alias("level")))).alias("rows")).withColumn("pause", pause)
    kept = F.expr("""aggregate(rows, cast(array() as array<struct<ts_sec:bigint,id:bigint,level:double>>),
      (kept, x) -> if(size(kept) = 0 or x.ts_sec - element_at(kept, -1).ts_sec >= pause, array_append(kept, x), kept))""")
    fired = islands.select("conversation_id", "trigger", F.explode(kept).alias("x")).select("conversation_id", "x.id", "x.ts_sec", "trigger", _severity(F.col("trigger")).alias("severity"), "x.level")
    quiet = silences(messages, now_sec, rules).select("conversation_id", "id", "ts_sec", F.lit("silence").alias("trigger"), F.lit(SEVERITIES["silence"]).alias("severity"), F.lit(0.0).alias("level"))
    return fired.unionByName(quiet)


class _Follow(StatefulProcessor):
    """A tracker per conversation in a value state, and one processing-time timer for its silence."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("tracker", "data string")

    def _tracker(self) -> Tracker:
        return Tracker.read(self.state.get()[0]) if self.state.exists() else Tracker()

    def _wait(self, tracker: Tracker, now_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        tracker.since = now_ms / 1000
        self.handle.registerTimer(now_ms + self.rules.silence * 1000)

    @staticmethod
    def _rows(frames: Iterator[pd.DataFrame]) -> list[tuple]:
        rows = pd.concat(list(frames)).sort_values(["ts_sec", "id"])
        return list(zip(*(rows[c].tolist() for c in SEEN), strict=True))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
        tracker = Tracker()
        for row in self._rows(iter([initialState])):
            tracker.take(row, self.rules, warming=True)
        now = timerValues.getCurrentProcessingTimeInMs()
        # an old silence is not this stream's to tell; a recent one counts from now on
        if tracker.window and now / 1000 - tracker.window[-1][1] <= self.rules.silence:
            self._wait(tracker, now)
        self.state.update((tracker.write(),))

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        tracker, found = self._tracker(), []
        for row in self._rows(rows):
            found += [(key[0], row[0], row[1], name, SEVERITIES[name], float(row[3])) for name in tracker.take(row, self.rules)]
        self._wait(tracker, timerValues.getCurrentProcessingTimeInMs())
        self.state.update((tracker.write(),))
        yield _told(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        tracker = self._tracker()
        if tracker.since is not None and tracker.window:
            tracker.since = None
            self.state.update((tracker.write(),))
            newest = tracker.window[-1]
            yield _told([(key[0], newest[0], newest[1] + self.rules.silence, "silence", SEVERITIES["silence"], 0.0)])

    def close(self) -> None:
        pass


def _told(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conversation_id", "id", "ts_sec", "trigger", "severity", "level"]).astype({"conversation_id": "int64", "id": "int64", "ts_sec": "int64", "level": "float64"})


def baseline(messages: DataFrame, until_sec: int) -> DataFrame:
    """What a stream starts from: the last messages of each conversation up to a time, as many as its state holds."""
    rows = messages.where(F.col("ts_sec") <= until_sec).withColumn("_k", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("ts_sec"), F.desc("id"))))
    return rows.where(F.col("_k") <= WINDOW).drop("_k")


def triggers_stream(messages: DataFrame, rules: Rules = RULES, start: DataFrame | None = None) -> DataFrame:
    """The same over a stream of messages of :func:`marked`; rows must come in order per conversation, as from an append-only log.

    ``start`` holds messages seen before (see :func:`baseline`), which warm the windows without firing. A conversation is silent ``rules.silence``
    seconds of processing time after its last message, told once. The session must keep state in RocksDB, see :func:`needs_rocksdb`.
    """
    columns = ["conversation_id", *SEEN]
    initial = start.select(*columns).groupBy("conversation_id") if start is not None else None
    return messages.select(*columns).groupBy("conversation_id").transformWithStateInPandas(_Follow(rules), FIRED, "Append", "ProcessingTime", initial)


def needs_rocksdb(spark) -> None:  # noqa: ANN001
    """Sets the state store that streams with timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def deduplicated(stream: DataFrame, key: list[str], time: str = "ts") -> DataFrame:
    """A stream without repeated captures; keys are remembered for as long as rows may be late."""
    return stream.withWatermark(time, LATENESS).dropDuplicatesWithinWatermark(key)


def sessions_stream(stream: DataFrame, gap: str = "30 minutes", time: str = "ts") -> DataFrame:
    """Session windows per conversation, closed by the watermark."""
    window = F.session_window(time, gap)
    return stream.withWatermark(time, LATENESS).groupBy("conversation_id", window.alias("w")).agg(F.count("*").alias("n")).select("conversation_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")
