"""Context-triggered piecewise hashing of texts.

A rolling hash over seven bytes ends a chunk wherever it hits a trigger value modulo the block size, so an edit moves
only nearby boundaries. Each chunk gives one of 64 letters. Block sizes are 3 * 2**k; a fingerprint holds the letters at
the size that suits the text's length and at twice that size, and two fingerprints are compared by edit distance
where they share a block size. All steps are numpy over whole texts and batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.support import mix64, shuffle_partitions, staged

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, LEAST_BLOCK, LETTERS = 7, 3, 64
#: Letters of a signature at most; its last chunk takes what is left of the text.
MOST_LETTERS = 2 * LETTERS
#: Where rows without an id stand.
LEAST_ID = -(1 << 63)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ROLL = (_BYTES >> np.uint64(32)).astype(np.uint32)
_ALPHABET = np.frombuffer(ALPHABET.encode(), np.uint8)
#: An odd multiplier and its inverse modulo 2**64, for chunk hashes that don't depend on where the chunk lies.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    def __init__(self) -> None:
        self.up, self.down = (np.ones(1, np.uint64) for _ in range(2))

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _letters(data: np.ndarray, ends: np.ndarray, hashed: np.ndarray) -> str:
    """One letter per chunk; ``ends`` are the last positions of chunks, the rest of the text is a last chunk."""
    starts = np.concatenate([[0], ends + 1])
    if starts[-1] >= len(data):
        starts = starts[:-1]
    sums = np.add.reduceat(hashed, starts) * _POWERS.of(len(data))[1][starts]
    return _ALPHABET[(mix64(sums) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    """``block:letters:letters at twice the block``; an empty text gives ``3::``."""
    n = len(text)
    if not n:
        return f"{LEAST_BLOCK}::"
    data = np.frombuffer(text, np.uint8)
    mixed = _ROLL[data]
    roll = mixed.copy()
    for i in range(1, min(WINDOW, n)):
        roll[i:] ^= (mixed[:-i] << np.uint32(4 * i)) | (mixed[:-i] >> np.uint32(32 - 4 * i))
    block = LEAST_BLOCK
    while block * LETTERS < n:
        block *= 2
    hashed = _BYTES[data] * _POWERS.of(n)[0]
    at = np.flatnonzero(roll % np.uint32(LEAST_BLOCK) == LEAST_BLOCK - 1) if block == LEAST_BLOCK else None
    while True:
        # triggers of a block size are among those of half of it
        ends = at if at is not None else np.flatnonzero(roll % np.uint32(block) == block - 1)
        if block == LEAST_BLOCK or len(ends) >= LETTERS // 2 - 1:
            break
        block, at = block // 2, None
    twice = ends[roll[ends] % np.uint32(2 * block) == 2 * block - 1]
    # a periodic text has far more triggers than its length asks for: larger blocks while they have some, and one chunk for the rest
    while len(ends) > MOST_LETTERS and len(twice) >= LETTERS // 2:
        block, ends = 2 * block, twice
        twice = ends[roll[ends] % np.uint32(2 * block) == 2 * block - 1]
    ends, twice = ends[: MOST_LETTERS - 1], twice[: MOST_LETTERS - 1]
    return f"{block}:{_letters(data, ends, hashed)}:{_letters(data, twice, hashed)}"


def _edit_likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """1 - insertions and deletions / both lengths, for many pairs of strings at once."""
    if not pairs:
        return np.empty(0)
    la, lb = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    a, b = (np.zeros((len(pairs), max(1, n.max())), np.uint8) for n in (la, lb))
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)] = np.frombuffer(x.encode(), np.uint8)
        b[i, : len(y)] = np.frombuffer(y.encode(), np.uint8)
    width = b.shape[1]
    steps = np.arange(width + 1, dtype=np.int32)
    row = np.broadcast_to(steps, (len(pairs), width + 1)).copy()
    last = row[np.arange(len(pairs)), lb].copy()
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + 2 * (a[:, i : i + 1] != b))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        done = la == i + 1
        last[done] = row[done, lb[done]]
    return 1 - last / np.maximum(1, la + lb)


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for pairs of fingerprints: the larger likeness over the block sizes that both have, 0 if there are none.

    Equal fingerprints are alike by 1. Pairs are compared in groups of like length, so that short ones stay cheap.
    """
    out = np.zeros(len(pairs))
    todo: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1
            continue
        (p, a, aa), (q, b, bb) = x.split(":"), y.split(":")
        if p == q:
            todo += [(i, a, b), (i, aa, bb)]
        elif int(p) == 2 * int(q):
            todo.append((i, a, bb))
        elif 2 * int(p) == int(q):
            todo.append((i, aa, b))
    todo = sorted((x for x in todo if x[1] and x[2]), key=lambda x: (max(map(len, x[1:])), len(x[1])))
    lo = 0
    while lo < len(todo):
        # a group's strings are padded to its longest, so it ends where they have grown by half
        longest = max(map(len, todo[lo][1:]))
        hi = lo + 1
        while hi < min(len(todo), lo + 512) and max(map(len, todo[hi][1:])) <= 16 + 1.5 * longest:
            hi += 1
        np.maximum.at(out, [x[0] for x in todo[lo:hi]], _edit_likeness([x[1:] for x in todo[lo:hi]]))
        lo = hi
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
#: Rows of a range besides those that are done: its last document, which lacks its next one, and its first one, which is that of the range before.
_LAST, _FIRST = "last", "first"


def _complete(rows: list[tuple]) -> list[list]:
    """Columns of rows (doc_id, text, its fingerprint, next text, its fingerprint)."""
    texts = [edited(r[1], r[3]) for r in rows]
    raw = [t.encode() for t in texts]
    prints = [fingerprint(t) for t in raw]
    near = likeness([(r[2], e) for r, e in zip(rows, prints, strict=True)] + [(r[2], r[4]) for r in rows])
    return [[r[0] for r in rows], [len(r[1]) for r in rows], [hashlib.sha256(t).hexdigest() for t in raw], [r[2] for r in rows], prints, near[: len(rows)], near[len(rows) :]]


def _batch(columns: list, more: dict[str, pa.Array]) -> pa.RecordBatch:
    own = [pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)]
    return pa.RecordBatch.from_arrays([*own, *more.values()], names=[*_NAMES, *more])


def _within_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows in order: each is complete when the next one is there; its first and its last one are handed on with their texts."""
    part = TaskContext.get().partitionId()

    def marked(columns: list, role: str | None, text: str | None) -> pa.RecordBatch:
        n = len(columns[0])
        return _batch(columns, {"part": pa.array([part] * n, pa.int32()), "role": pa.array([role] * n, pa.string()), "text": pa.array([text] * n, pa.string())})

    def edge(row: tuple, role: str) -> pa.RecordBatch:
        return marked([[row[0]], [len(row[1])], [None], [row[2]], [None], [None], [None]], role, row[1])

    previous, held = None, []
    for batch in batches:
        for doc, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            own = (doc, text or "", fingerprint((text or "").encode()))
            if previous is None:
                yield edge(own, _FIRST)
            else:
                held.append((*previous, *own[1:]))
            previous = own
        yield marked(_complete(held), None, None)
        held = []
    if previous is not None:
        yield edge(previous, _LAST)


def _across_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch(_complete(list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))), {})


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The next document is the one with the next larger id; rows without an id come first, rows that share one (ties) are
    ordered by a hash of their text, and the last is followed by the first (a single document by itself). A null
    text is empty; whole texts are read, however long; a signature is bounded. A table without rows gives none. Columns
    other than the two named are not looked at, so that their names don't matter.

    Texts are dealt to ranges of (id, hash, place in the input) and sorted within, each sent once, so that rows without an id, or
    with one id, spread as others do. Within a range rows wait for the next one only; the two documents at each border meet in
    a second, small step, a row per range.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.coalesce("doc_id", F.lit(LEAST_ID)), F.col("doc_id").isNotNull(), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = own.select("doc_id", "text", *(c.alias(f"_{i}") for i, c in enumerate(order)))
    keys = [f"_{i}" for i in range(len(order))]
    ranged = keyed.repartitionByRange(shuffle_partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    found = staged(ranged.mapInArrow(_within_range, f"{_OUT}, part int, role string, text string"))
    last, first = (found.where(F.col("role") == r) for r in (_LAST, _FIRST))
    # a number per range that has rows: which one comes next, the first one after the last
    parts = last.select("part").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    following = parts.select(F.posexplode("parts").alias("i", "part"), "parts").select("part", F.element_at("parts", (F.col("i") + 1) % F.size("parts") + 1).alias("to"))
    met = last.join(following, "part").join(first.select(F.col("part").alias("to"), F.col("text").alias("next"), F.col("fingerprint").alias("next_mark")), "to")
    closed = met.select("doc_id", "text", "fingerprint", "next", "next_mark").mapInArrow(_across_ranges, _OUT)
    return found.where("role is null").select(*_NAMES).unionByName(closed)
