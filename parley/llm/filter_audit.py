"""Filter interaction audit: what each filter removes, in every order, from one histogram of failure masks.

Each document gets a mask with a bit for every filter that it fails. What any order of filters keeps, removes or finds
already removed depends on the counts of these masks only, so that the table is read once: 32 cells a part are counted,
and all permutations are worked out from the cells.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_BLANK_RUNS = r"[\x20\x09-\x0D]+"

#: A filter's failure condition, from a text and its words.
Condition = Callable[[Column, Column], Column]


def too_short(text: Column, words: Column) -> Column:  # noqa: ARG001
    return F.size(words) < 100


def too_repetitive(text: Column, words: Column) -> Column:  # noqa: ARG001
    return 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long")


def too_loud(text: Column, words: Column) -> Column:  # noqa: ARG001
    return 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text)


def has_symbols(text: Column, words: Column) -> Column:  # noqa: ARG001
    return text.rlike("[#$%&*|]")


#: The filters that look at one text; the one after them fails copies of a text with a smaller id.
CONDITIONS: tuple[Condition, ...] = (too_short, too_repetitive, too_loud, has_symbols)


def _letters(n: int) -> str:
    return "".join(chr(ord("A") + i) for i in range(n))


def failure_masks(docs: DataFrame, conditions: tuple[Condition, ...] = CONDITIONS) -> DataFrame:
    """``doc_id, part, key, mask`` of every row: the text's SHA-256 and a bit for each of ``conditions`` that the text fails."""
    texts = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.withColumn("words", F.array_remove(F.split("text", _BLANK_RUNS), ""))
    bits = [F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, fails in enumerate(conditions)]
    return texts.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), sum(bits, F.lit(0)).alias("mask"))


def mask_cells(docs: DataFrame, labels: DataFrame, conditions: tuple[Condition, ...] = CONDITIONS) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and failure mask, of them those labelled good and toxic.

    Equal rows are counted before anything is joined; ids are salted where they are null, so that such rows don't meet in
    one task. Copies of a text are counted by part and label before the smallest id of the text decides which ones fail.
    """
    rows = failure_masks(docs, conditions).groupBy("doc_id", "key", "part", "mask").agg(F.count("*").alias("n"))
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.crc32("key")).otherwise(0).cast("long"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(m) for c, m in (("quality", "is_good"), ("toxic", "is_toxic"))))
    rows = rows.join(marks.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").fillna(False, ["is_good", "is_toxic"])
    unnamed = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    texts = rows.groupBy("key", "part", "mask", "is_good", "is_toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"), unnamed.alias("n_unnamed"))
    least = F.min("first").over(Window.partitionBy("key"))  # a row per part and label only
    kept = F.col("n_unnamed") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    texts = texts.withColumn("least", least).withColumn("n_kept", kept)
    both = F.array(F.struct("mask", F.col("n_kept").alias("n")), F.struct((F.col("mask") + (1 << len(conditions))).alias("mask"), (F.col("n") - F.col("n_kept")).alias("n")))
    cells = texts.select("part", "is_good", "is_toxic", F.explode(both).alias("c")).where("c.n > 0")
    of = lambda mark: F.sum(F.when(F.col(mark), F.col("c.n")).otherwise(0))
    return cells.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), of("is_good").alias("good"), of("is_toxic").alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame, conditions: tuple[Condition, ...] = CONDITIONS) -> DataFrame:
    """A row per part, order of the filters and step: ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``.

    Filters are ``A``, ``B``, ... for ``conditions`` in their order, and the next letter for copies: texts that some
    smaller ``doc_id`` has too, in any part. A part is a value of ``lang``.

    Null texts count as empty ones, null languages as the part of the empty string. Rows without an id are no copies and
    make none. Rows that share an id and a text stand or fall together; a document is good or toxic if any of its labels
    says so, and null or unknown labels say nothing. Texts are judged whole, however long. An empty table has no parts and
    gives no rows. Columns other than ``doc_id, text, lang`` and ``doc_id, quality, toxic`` are not looked at.
    """
    n = len(conditions) + 1
    letters, each = _letters(n), factorial(n)
    cells = mask_cells(docs, labels, conditions).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^n at most
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    steps = cells.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    place = lambda i: F.expr(f"shiftleft(1, ascii(substring(filter_order, {i}, 1)) - ascii('A'))")
    before = F.expr(f"aggregate(filter(sequence(1, {n}), i -> i < step), 0, (a, i) -> a | shiftleft(1, ascii(substring(filter_order, i, 1)) - ascii('A')))")
    steps = steps.withColumn("own", place("step")).withColumn("before", before)
    total = lambda value, where: F.expr(f"aggregate(cells, 0L, (a, c) -> a + if({where}, {value}, 0L))")
    here, late = "c.mask & own != 0 and c.mask & before = 0", "c.mask & own != 0 and c.mask & before != 0"
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), total("c.n", "c.mask & (own | before) = 0").alias("kept"), total("c.n", here).alias("removed"),
        total("c.n", late).alias("redundant"), total("c.n", "c.mask = own").alias("unique_fails"), total("c.good", here).alias("good_lost"),
        # a document is removed by each of the filters that it fails in equally many orders
        total("c.toxic", here).alias("toxic_lost"), total(f"c.n * {each} div bit_count(c.mask)", "c.mask & own != 0").alias("shapley"),
    )
