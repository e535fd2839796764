"""A corpus pipeline of five stages, each one of the corpus operators, from ``documents`` to packed sequences.

Each stage gets all that its predecessor kept, written as Parquet and read again. Whole texts are judged and kept, however long; columns
may have any names, those of the stages' own included.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.line_dedup import with_kept_lines
from parley.llm.mixing import mix_sources, word_count
from parley.llm.near_dedup import keep_one_per_group
from parley.llm.packing import pack_documents
from parley.llm.quality import THRESHOLD, scorer, train
from parley.llm.support import WORD, shared_folder


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is below the threshold go; all labels may be learned from.

    Null and empty texts are judged as texts without words; rows that share an id or a text (ties) are judged each; without labels
    none goes; no documents give none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    vectors, net = train(docs.select("doc_id", "text"), labels)
    return docs.where(scorer(spark, vectors, net)(F.col("text")) >= THRESHOLD)


def _changed(rows: DataFrame, columns: list[str], changed: Column, text: Column) -> DataFrame:
    """The columns of a struct ``row``, with another text (and its ``n_chars``) where it has changed."""
    own = {c: F.col("row")[c] for c in columns}
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*(F.when(changed, new[c]).otherwise(own[c]).alias(c) if c in new else own[c].alias(c) for c in columns))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Lines that many documents share stay in one of them; ``n_chars`` follows the text where it changes.

    Null texts stay null and empty ones empty; rows that share an id (ties) lose the same lines; rows without an id lose none.
    """
    return _changed(with_kept_lines(docs), docs.columns, F.col("kept.n_dropped") > 0, F.col("kept.text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Of each group of near copies the document with the least id stays.

    Null and blank texts and rows without an id are no copies of anything and stay; all rows of an id that stays do, so that
    rows tie only with themselves.
    """
    return keep_one_per_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Documents as often as the mix takes them, a row per copy; a copy that is taken in part keeps its first words.

    Rows that share an id (ties) have the same places in the mix; each of them is taken as often as the id's longest one. Null and
    empty texts are never taken.
    """
    taken = mix_sources(docs).where("taken > 0").select(F.col("doc_id").alias("of"), F.explode("draws").alias("d"))
    taken = taken.groupBy("of", "d.pass").agg(F.max("d.words").alias("words"))
    rows = docs.select(F.struct(*docs.columns).alias("row")).join(taken, F.col("row.doc_id").eqNullSafe(F.col("of")))
    cut = F.col("words") < word_count(F.col("row.text"))
    first = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    return _changed(rows, docs.columns, cut, first)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Pieces of packed sequences; null and empty texts give one id each, repeated rows are packed each."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_common_lines),
    ("near dedup", drop_near_copies),
    ("source mixing", mix),
    ("packing", pack),
]

#: The classifier, the mix and the packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's files go once the next one's are written."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        if i:
            _remove(spark, f"{folder}/{i - 1}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001
