"""Topic segments of timelines: cuts where the talk pauses and its words change, short segments merged, long ones in windows.

Whether a message begins a segment depends on the open segment only through its length (up to ten) and its last six
messages. Both follow from how many messages it has. So each message gets a mask that says for each length whether it
would cut, by windows over its day, as every midnight cuts; the fold that remains holds one number. Merging looks at
neighbouring segments of less than half an hour apart, whose number is bounded by their pauses and not by their messages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import bound, character_grams
from parley.operators.lineage import staged
from parley.operators.timeline import crosses_sleep

KEY = "conversation_id"
#: Where words end: white space, and the marks of Chinese and Western writing that count here.
DELIMITERS = r"(?U)[\s,，。！？；：、/()（）\[\]\-~～]+"


@dataclass(frozen=True)
class Limits:
    """Seconds, messages and characters of the rules."""

    hard_gap: int = 7_200
    soft_gap: int = 1_800
    shift_gap: int = 300
    shift_messages: int = 10
    least_overlap: float = 0.1
    seen: int = 6
    merge_gap: int = 1_800
    least_messages: int = 3
    most_messages: int = 40
    most_chars: int = 3_000
    window: int = 32
    step: int = 28
    content: int = 240
    tokens: int = 80
    topics: int = 8


LIMITS = Limits()


def _words(text: Column) -> Column:
    return F.filter(F.split(text, DELIMITERS), lambda w: F.length(w) >= 2)


def _without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def _all_tokens(words: Column, compact: Column, most: int) -> Column:
    return F.slice(F.array_distinct(F.concat(words, *(character_grams(compact, n) for n in (2, 3, 4)))), 1, most)


def topic_tokens(text: Column, most: int = LIMITS.tokens) -> Column:
    """Words of two characters or more, then all runs of two, three and four characters without white space, each once."""
    return bound(_without_space(text), lambda compact: _all_tokens(_words(text), compact, most))


def _topics_of(words: Column, compact: Column, stop_words: tuple[str, ...], limits: Limits) -> Column:
    """:func:`topics` of a text by its words and its characters without white space."""
    enough = min(limits.tokens, limits.topics + len(stop_words))
    few = F.array_distinct(F.concat(words, character_grams(F.substring(compact, 1, 3 * enough), 2)))
    rest = bound(few, lambda f: F.when(F.size(f) >= enough, F.slice(f, 1, limits.tokens)).otherwise(_all_tokens(words, compact, limits.tokens)))
    kept = bound(F.array_distinct(words), lambda w: F.when(F.size(w) >= enough, F.slice(w, 1, limits.tokens)).otherwise(rest))
    if stop_words:
        kept = F.array_except(kept, F.array(*(F.lit(w) for w in stop_words)))
    return F.slice(kept, 1, limits.topics)


def topics(text: Column, stop_words: tuple[str, ...] = (), limits: Limits = LIMITS) -> Column:
    """The first tokens of a text that are no stop words.

    So many tokens that enough are left whatever the stop words are mostly lie in the words and the first runs, else all are found.
    """
    parts = F.struct(_words(text).alias("words"), _without_space(text).alias("compact"))
    return bound(parts, lambda p: _topics_of(p["words"], p["compact"], stop_words, limits))


def compacted(content: Column, limits: Limits = LIMITS) -> Column:
    """White space collapsed, at most so many characters; null where nothing is left."""
    text = F.substring(F.trim(F.regexp_replace(content, r"(?U)\s+", " ")), 1, limits.content)
    return F.when(F.length(text) > 0, text)


def _overlap(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared).otherwise(0.0)


def cut_masks(rows: DataFrame, stop_words: tuple[str, ...] = (), limits: Limits = LIMITS) -> DataFrame:
    """``rows(conversation_id, day, id, ts, ts_sec, content)`` with ``mask``: its bit n tells whether the row begins a segment where the open one
    has n messages; the highest bit stands for that many or more."""
    own = Window.partitionBy(KEY, "day").orderBy("ts_sec", "id")
    parts = rows.withColumn("parts", F.struct(_words(F.col("content")).alias("words"), _without_space(F.col("content")).alias("compact")))
    near = parts.withColumns({"prev_ts": F.lag("ts").over(own), "gap": F.col("ts_sec") - F.lag("ts_sec").over(own), "before": F.collect_list("parts").over(own.rowsBetween(-limits.seen, -1))})
    forced = F.col("prev_ts").isNull() | ((F.col("gap") > 0) & (crosses_sleep(F.col("prev_ts"), F.col("ts")) | (F.col("gap") > limits.hard_gap)))
    asks = ~forced & (F.col("gap") >= limits.shift_gap) & (F.size("before") > 0)
    most = max(limits.seen, limits.shift_messages)

    def met(own: Column, k: Column) -> Column:
        """How much the last ``k`` messages talk of the same, and whether both talk of anything."""
        last = F.slice("before", -k, k)  # texts end words, so that the words of several are the words of each
        told = bound(F.struct(F.flatten(last["words"]).alias("words"), F.array_join(last["compact"], "").alias("compact")), lambda p: _topics_of(p["words"], p["compact"], stop_words, limits))
        return bound(told, lambda t: F.struct(_overlap(t, own).alias("share"), ((F.size(t) > 0) & (F.size(own) > 0)).alias("both")))

    def cuts(shares: Column, n: int) -> Column:
        last = F.element_at(shares, F.least(F.lit(n), F.size(shares)))  # the only one where one is asked for
        apart = (F.col("gap") > limits.soft_gap) & (last["share"] <= limits.least_overlap)
        return apart | ((last["share"] == 0) & last["both"]) if n >= limits.shift_messages else apart

    own = _topics_of(F.col("parts.words"), F.col("parts.compact"), stop_words, limits)
    # a short pause asks for the longest context only, which alone a segment of many messages is judged by
    asked = F.when(F.col("gap") > limits.soft_gap, F.lit(1)).otherwise(F.size("before")) if limits.shift_messages >= limits.seen else F.lit(1)
    shares = bound(own, lambda o: F.transform(F.sequence(asked, F.size("before")), lambda k: met(o, k)))
    masked = bound(shares, lambda x: sum((F.when(cuts(x, n), 1 << n).otherwise(0) for n in range(1, most + 1)), F.lit(0)))
    return near.withColumn("mask", F.when(forced, (2 << most) - 1).when(asks, masked).otherwise(0)).drop("prev_ts", "before", "parts")


def _folded(rows: DataFrame, limits: Limits) -> DataFrame:
    """Rows with ``segment``, its number within the day, and their ``place`` in it. Rows pass in order; a task holds one batch and the
    number of messages of the open segment."""
    most = max(limits.seen, limits.shift_messages)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, segment = None, 0, 0
        for batch in batches:
            segments, places = [], []
            for own, mask in zip(zip(batch[KEY].tolist(), batch["day"].tolist(), strict=True), batch["mask"].tolist(), strict=True):
                if own != key:
                    key, n, segment = own, 0, -1
                if n == 0 or mask >> min(n, most) & 1:
                    n, segment = 0, segment + 1
                n += 1
                segments.append(segment)
                places.append(n - 1)
            yield batch.drop(columns="mask").assign(segment=segments, place=places)

    narrow = rows.select(KEY, "day", "id", "ts_sec", F.length("content").cast("long").alias("chars"), "mask")
    ordered = narrow.sortWithinPartitions(KEY, "day", "ts_sec", "id")
    return ordered.mapInPandas(fold, f"{KEY} long, day date, id long, ts_sec long, chars long, segment long, place long")


def _merged(segments: DataFrame, limits: Limits) -> DataFrame:
    """Segments by day with the ``topic`` that they belong to, and the ``offset`` of their first message in it."""
    order = Window.partitionBy(KEY).orderBy("day", "segment")  # a row per segment
    near = segments.withColumns({
        "far": F.coalesce(F.col("start_sec") - F.lag("end_sec").over(order) > limits.merge_gap, F.lit(True)),
        "close_next": F.coalesce(F.lead("start_sec").over(order) - F.col("end_sec") <= limits.merge_gap, F.lit(False)),
    })
    near = near.withColumn("island", F.sum(F.col("far").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("day", "segment", "start_sec", "end_sec", "n", "chars", "far", "close_next")
    islands = near.groupBy(KEY, "island").agg(F.array_sort(F.collect_list(item)).alias("items"))
    # a short segment takes the next one in where that is close, else it goes to the one before
    begun = F.expr(f"""aggregate(items, struct(cast(array() as array<boolean>) as flags, false as open), (a, x) -> struct(
      array_append(a.flags, not a.open and not (x.n < {limits.least_messages} and not x.close_next and not x.far)) as flags, not a.open and x.n < {limits.least_messages} and x.close_next as open)).flags""")
    flat = islands.select(KEY, F.explode(F.arrays_zip("items", begun.alias("begins"))).alias("x")).select(KEY, "x.items.*", F.col("x.begins").alias("begins"))
    numbered = flat.withColumn("topic", F.sum(F.col("begins").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    own = Window.partitionBy(KEY, "topic")
    before = F.coalesce(F.sum("n").over(own.orderBy("day", "segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return numbered.withColumns({"offset": before, "topic_n": F.sum("n").over(own), "topic_chars": F.sum("chars").over(own)}).select(KEY, "day", "segment", "topic", "offset", "topic_n", "topic_chars")


def topic_rows(messages: DataFrame, stop_words: tuple[str, ...] = (), limits: Limits = LIMITS) -> DataFrame:
    """``conversation_id, topic, part, id, ts_sec, chars``: each message with the topic segment it belongs to, and with the window of it where it is
    cut into windows (neighbours share messages, which have a row in each).

    ``messages`` are ``conversation_id, id, ts, ts_sec, content``. Blank contents are left out; content counts up to a length.
    """
    rows = messages.select(KEY, "id", "ts", "ts_sec", F.to_date("ts").alias("day"), compacted(F.col("content"), limits).alias("content")).where("content is not null")
    # both uses of the folded rows read what is kept here, so that masks are found once; of an exchange each would ask other columns, and make its own
    folded = staged(_folded(cut_masks(rows, stop_words, limits), limits).repartition(KEY, "day"))
    segments = folded.groupBy(KEY, "day", "segment").agg(F.min("ts_sec").alias("start_sec"), F.max("ts_sec").alias("end_sec"), F.count("*").alias("n"), F.sum("chars").alias("chars"))
    placed = folded.join(_merged(segments, limits), [KEY, "day", "segment"]).withColumn("k", F.col("offset") + F.col("place"))
    windows = F.greatest(F.lit(1), F.ceil((F.col("topic_n") - limits.window) / limits.step) + 1)
    large = (F.col("topic_n") > limits.most_messages) | (F.col("topic_chars") > limits.most_chars)
    # the last windows that begin at or before a message, as far as they reach it
    reach = -(-limits.window // limits.step)
    near = F.array(*((F.col("k") / limits.step).cast("long") - i for i in range(reach)))
    parts = F.filter(near, lambda p: (p >= 0) & (p < windows) & (F.col("k") < p * limits.step + limits.window))
    return placed.select(KEY, "topic", F.explode(F.when(large, parts).otherwise(F.array(F.lit(0).cast("long")))).alias("part"), "id", "ts_sec", "chars")


def topic_segments(messages: DataFrame, stop_words: tuple[str, ...] = (), limits: Limits = LIMITS) -> DataFrame:
    """``conversation_id, topic, part, start_sec, end_sec, n, chars, first_id, last_id`` of the segments of :func:`topic_rows`."""
    at = F.struct("ts_sec", "id")
    return topic_rows(messages, stop_words, limits).groupBy(KEY, "topic", "part").agg(
        F.min("ts_sec").alias("start_sec"), F.max("ts_sec").alias("end_sec"), F.count("*").alias("n"), F.sum("chars").alias("chars"), F.min_by("id", at).alias("first_id"), F.max_by("id", at).alias("last_id")
    )
