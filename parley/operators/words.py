"""Counts of documents' words by document, by weight and between neighbours, without a shuffle of single words where a document's own row will do."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import tokens
from parley.llm.support import sliced
from parley.operators.lineage import staged

#: Ids of a block of neighbours, which one task compares one after the other.
BLOCK = 1_000


def _told(text: Column) -> Column:
    """A text's words with one blank between them; words hold none."""
    return F.array_join(tokens(text), " ")


def weighted_counts(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """``lang, token, n``: the words of ``docs(doc_id, text)``, each as often as ``weights(doc_id, lang, times)`` say for its document.

    Texts meet the weights, and words are taken from them afterwards: no word is sent or sorted by document. Rows without an id have no weight.
    """
    told = docs.select("doc_id", "text").join(weights, "doc_id").select("lang", "times", F.explode(tokens(F.col("text"))).alias("token"))
    return told.groupBy("lang", "token").agg(F.sum("times").alias("n"))


def variety(docs: DataFrame) -> DataFrame:
    """``doc_id, words, kinds, spread`` of ``docs(doc_id, text)`` that have words; ``spread`` is the sum of n ln n over a document's different words.

    Rows whose id occurs once are counted where they are. The words of rows that share an id, those without one included, are counted by a shuffle.
    """
    docs = docs.select("doc_id", "text")
    repeated = staged(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, words long, kinds long, spread double"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            found = [Counter(t.split(" ")).values() if t else () for t in batch.column(1).to_pylist()]
            spread = [math.fsum(n * math.log(n) for n in c if n > 1) for c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(sum, found), pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(spread, pa.float64())], ["doc_id", "words", "kinds", "spread"])

    single = docs if repeated.isEmpty() else docs.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    own = single.select("doc_id", _told(F.col("text")).alias("told")).mapInArrow(counted, schema).where("words > 0")
    if single is docs:
        return own
    shared = docs.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("doc_id", F.explode(tokens(F.col("text"))).alias("token"))
    n = shared.groupBy("doc_id", "token").agg(F.count("*").alias("n")).groupBy("doc_id")
    return own.unionByName(n.agg(F.sum("n").alias("words"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.ln("n")).alias("spread")))


def neighbour_products(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, shared, own, next``: the product of the word counts of a document and of the one with the next id, and each one's with itself,
    for ``docs(doc_id, text)`` that share a word.

    Texts go once to the block of their id, the first of a block also to the one before. There they pass in order; a task holds the counts of
    two documents. Rows that share an id are one document; rows without an id have no neighbours.
    """
    first = F.floor(F.col("doc_id") / block).cast("long")
    at = F.explode(F.when(F.col("doc_id") % block == 0, F.array(first, first - 1)).otherwise(F.array(first)))
    rows = docs.where("doc_id is not null").select("doc_id", "text", at.alias("block")).select("block", F.col("doc_id").cast("long").alias("doc_id"), _told(F.col("text")).alias("told"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, before, found = None, Counter(), None, []

        def ended() -> None:
            """Compares the document that has ended with the one before it, if that is its neighbour."""
            nonlocal before
            if key is not None:
                norm = sum(n * n for n in now.values())
                if before is not None and before[0] == (key[0], key[1] - 1):
                    shared = sum(n * before[1][t] for t, n in now.items() if t in before[1])
                    if shared:
                        found.append((key[1] - 1, shared, before[2], norm))
                before = key, now, norm

        def rows_found() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 4
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "shared", "own", "next"])

        for batch in sliced(batches, 2):
            for b, doc_id, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (b, doc_id) != key:
                    ended()
                    key, now = (b, doc_id), Counter()
                if told:
                    now.update(told.split(" "))
            yield rows_found()
        ended()
        yield rows_found()

    ordered = rows.repartition("block").sortWithinPartitions("block", "doc_id")
    return ordered.mapInArrow(products, "doc_id long, shared long, own long, next long")
