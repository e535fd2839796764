"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it. Only a session on one machine, as in
    tests, may name none and gets a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return found or tempfile.mkdtemp(prefix="parley-")


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder that all executors share. A lost executor costs the tasks it ran, not
    the stages before; Spark's cleaner removes what no frame refers to any more where it is told to."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(column: pa.Array, most: int = 2_000_000) -> Iterator[slice]:
    """Rows of a column of texts in runs of about ``most`` bytes, so that a batch's rows aren't all taken apart at once; a
    longer text stands alone."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        upto = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(first, upto)
        first = upto


def sliced(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches cut by :func:`text_slices` of their column ``text``; an empty batch passes as it is. What a batch no longer needs goes back to the system."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
        for rows in text_slices(batch.column(text)):
            yield batch.slice(rows.start, rows.stop - rows.start)
        pa.default_memory_pool().release_unused()


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered for up to ``limit`` words."""

    def __init__(self, seed: int = 0, limit: int = 150_000) -> None:
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text: maximal runs without ASCII white space, A-Z lower-cased."""
    return text.lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers, in place where possible."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
