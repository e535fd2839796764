"""Repeated lines: a sharded minimal perfect hash over the distinct line hashes that repeat, probed by documents.

Each shard holds, for its keys, the levels of a minimal perfect hash (keys that collide at one level go on to the
next), and at the hash's positions three compact arrays: fingerprint, document count and last document. A document
sends its own distinct line hashes to the shards and gets back which of them to drop; lines are never joined with
lines. A shard is copied for ``COPIES`` groups of documents, so that a line of a third of all documents is probed in
many tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.support import BLANKS, mix64, sliced, staged

#: A line counts from so many code points (without surrounding blanks) and so many documents on.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Keys of a shard on average, and copies of each shard.
SHARD_KEYS, COPIES = 20_000, 32
#: Levels of a perfect hash, each of which leaves less than half of its keys to the next.
MOST_LEVELS = 64
_BLANKS = BLANKS.encode()


def line_key(line: bytes) -> bytes | None:
    """The line without blanks at both ends, A-Z lower-cased; none if it is too short to count."""
    key = line.strip(_BLANKS).lower()
    if len(key) < LEAST_CHARS or (not key.isascii() and len(key.decode()) < LEAST_CHARS):
        return None
    return key


def key_hash(key: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(key))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: a key's position is the rank of its bit over all levels."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks, seen = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - 1 + seen)
            seen += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash | None:
        """None if some keys don't part in many levels, as equal ones never do."""
        levels, rest = [], keys.astype(np.uint64)
        while len(rest):
            if len(levels) == MOST_LEVELS:
                return None
            size = 2 * len(rest) + 1
            at = cls._slots(rest, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    @staticmethod
    def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys ^ mix64(np.array([level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(size)).astype(np.int64)

    def positions(self, keys: np.ndarray) -> np.ndarray:
        """Each key's position; for a key that was not built in, any position or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = self._slots(keys[open_].astype(np.uint64), level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<i", len(self.levels)) + b"".join(struct.pack("<q", len(x)) for x in self.levels)
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        (n,) = struct.unpack_from("<i", data)
        sizes, at, levels = struct.unpack_from(f"<{n}q", data, 4), 4 + 8 * n, []
        for size in sizes:
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(levels), at


class LineIndex:
    """The perfect hash of one shard's line hashes with its arrays."""

    def __init__(self, table: PerfectHash, seed: int, prints: np.ndarray, counts: np.ndarray, last: np.ndarray) -> None:
        self.table, self.seed, self.prints, self.counts, self.last = table, seed, prints, counts, last

    @classmethod
    def build(cls, h: np.ndarray, prints: np.ndarray, counts: np.ndarray, last: np.ndarray) -> LineIndex:
        """From distinct pairs (h, print). They are keyed by 64 bits of both; should two pairs share them, another seed parts them."""
        seed, table = -1, None
        while table is None:
            seed += 1
            table = PerfectHash.build(cls._joint(h, prints, seed))
        at = table.positions(cls._joint(h, prints, seed))
        out = [np.empty(len(h), np.int64) for _ in range(3)]
        for array, values in zip(out, (prints, counts, last), strict=True):
            array[at] = values
        return cls(table, seed, *out)

    @staticmethod
    def _joint(h: np.ndarray, prints: np.ndarray, seed: int = 0) -> np.ndarray:
        return mix64(h.astype(np.int64).view(np.uint64) + np.uint64(seed)) ^ prints.astype(np.int64).view(np.uint64)

    def find(self, h: np.ndarray, prints: np.ndarray) -> np.ndarray:
        at = self.table.positions(self._joint(h, prints, self.seed))
        return np.where((at >= 0) & (self.prints[at] == prints), at, -1)

    def to_bytes(self) -> bytes:
        return struct.pack("<q", self.seed) + self.table.to_bytes() + self.prints.tobytes() + self.counts.tobytes() + self.last.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> LineIndex:
        (seed,), data = struct.unpack_from("<q", data), data[8:]
        table, at = PerfectHash.from_bytes(data)
        n = (len(data) - at) // 24
        return cls(table, seed, *(np.frombuffer(data, np.int64, n, at + 8 * n * i) for i in range(3)))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1):
        ids, found = [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if i is not None and text:
                keys = {k for k in map(line_key, text.split(b"\n")) if k}
                ids += [i] * len(keys)
                found += [xxhash.xxh3_128_digest(k) for k in keys]
        two = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1])], names=["doc_id", "h", "print"])


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    index = LineIndex.build(*(rows[c].to_numpy(np.int64) for c in ("h", "print", "n", "last")))
    return pd.DataFrame({"shard": rows["shard"].iloc[:1], "index": [index.to_bytes()]})


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, copy, index first): a shard's index is kept while its probes pass."""
    index, of = None, None
    for batch in batches:
        shards, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        docs, h, prints = (batch.column(i).fill_null(0).to_numpy() for i in (2, 3, 4))
        cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(copies) != 0)) + 1
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for lo, hi in zip([0, *cuts], [*cuts, len(shards)], strict=True):
            if lo == hi:
                continue
            while lo < hi and batch.column(5)[lo].is_valid:
                index, of = LineIndex.from_bytes(batch.column(5)[lo].as_py()), (shards[lo], copies[lo])
                lo += 1  # noqa: PLW2901
            if lo == hi or of != (shards[lo], copies[lo]):
                continue
            d, x = docs[lo:hi], h[lo:hi]
            at = index.find(x, prints[lo:hi])
            drop = (at >= 0) & (index.counts[at] >= LEAST_DOCS) & (index.last[at] != d)
            out.append((d[drop], x[drop]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in (0, 1)], names=["doc_id", "h"])


def _without(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    out = []
    for text, drop in zip(texts, drops, strict=True):
        lines = (text or "").split("\n")
        if drop is None or not len(drop):
            out.append(("\n".join(lines), len(lines), 0))
            continue
        gone = set(map(int, drop))
        kept = [x for x in lines if (k := line_key(x.encode())) is None or key_hash(k)[0] not in gone]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


def repeated_line_index(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``docs(doc_id, text)`` to (its documents' distinct line hashes, the shards of the index, their number)."""
    keyed = docs.mapInArrow(_keyed, "doc_id long, h long, print long")
    counts = keyed.groupBy("h", "print").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
    counts = staged(counts.where(F.col("n") >= LEAST_DOCS))
    shards = 1 + counts.count() // SHARD_KEYS
    dealt = counts.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    return keyed, dealt.groupBy("shard").applyInPandas(_build, "shard int, index binary"), shards


def with_kept_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Two columns per row of ``docs``: ``kept``, a struct (text, n_lines, n_dropped), and ``row``, a struct of all its own columns.

    Rows are judged as in :func:`drop_repeated_lines`, whatever the names of their columns.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed, index, shards = repeated_line_index(own)
    probes = keyed.select(
        F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(COPIES)).cast("int").alias("copy"),
        "doc_id", "h", "print", F.lit(None).cast("binary").alias("index"),
    )
    nothing = F.lit(None).cast("long")
    copies = index.select("shard", F.explode(F.expr(f"sequence(0, {COPIES - 1})")).alias("copy"), nothing.alias("doc_id"), nothing.alias("h"), nothing.alias("print"), "index")
    dealt = probes.union(copies).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("index").isNull())
    drops = dealt.mapInArrow(_probe, "doc_id long, h long").groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("h").alias("drops"))
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    joined = packed.join(drops, F.col("row")[doc_id].cast("long") == F.col("of"), "left")
    return joined.select(F.pandas_udf(_without, "text string, n_lines long, n_dropped long")(F.col("row")[text].cast("string"), F.col("drops")).alias("kept"), "row")


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with three columns in front: ``kept_text, n_lines, n_dropped``; its other columns stay as they are, and
    own columns of those three names are left out.

    A null or empty text is one empty line. A line that repeats within a document counts once, as do rows that share
    an id; all of a document's copies of a dropped line go. Rows without an id are not counted and lose nothing.
    Very long texts are read whole, line by line. A table without rows gives none.
    """
    new = ("kept_text", "n_lines", "n_dropped")
    rest = [F.col("row")[c].alias(c) for c in docs.columns if c not in new]
    return with_kept_lines(docs, doc_id, text).select(*(F.col("kept")[c].alias(n) for c, n in zip(("text", "n_lines", "n_dropped"), new, strict=True)), *rest)
