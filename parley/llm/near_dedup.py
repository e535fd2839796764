"""Near-duplicate documents: fast similarity sketches, banding, and exact confirmation on full shingle sets.

Sketch: ``t`` bins are filled in rounds. In each of the first ``t`` rounds every shingle picks a bin and a value by
hash; in round ``t + j`` all go to bin ``j``, so that no bin stays empty however small the set is. A bin keeps its
least (round, value), and two bins of the same index agree with a probability equal to the Jaccard similarity.

Candidates never form pairs within a bucket. Documents with equal sets become one node first. Each bucket then
links its members to its least node (a star), stars are confirmed, and only members of one bucket that still lie in
different components are compared with each other: by 8-bit signatures in blocks of bounded size, then on full sets, and
no further once a block's pairs have joined their components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.components import components
from parley.llm.support import WordHashes, mix64, sliced, staged, words_of

BINS, BANDS, SHINGLE = 128, 32, 5
NEED, WHOLE = 75, 100
#: A pair of one bucket is confirmed if this many of the 128 signature bytes agree; at a similarity of 0.75, 96 are
#: expected with a standard deviation below 5, so that fewer are as rare as a pair that no band catches.
LEAST_AGREE = 74
#: Members compared with one centre, or other components' members in one block; shingles in one of these at most, on average.
BLOCK, SLICE, BLOCK_SHINGLES = 512, 1024, 2_000_000
#: Rows of ids (24 bytes each) that are broadcast to the texts at most; more are joined by a shuffle of both sides.
BROADCAST_ROWS = 1_000_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ROUNDS = mix64(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles; with fewer words the whole sequence is one."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 77)], np.uint64)
    h = hashes.of(words)
    n = len(h) - SHINGLE + 1
    acc = h[:n].copy()
    for i in range(1, SHINGLE):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
        acc += h[i : n + i]
    return np.unique(mix64(acc))


def sketch(elements: np.ndarray) -> np.ndarray:
    """The 128 bins of a non-empty set. The round stands above the hash, so the least value is the first fill."""
    bins, n, i = np.full(BINS, _EMPTY, np.uint64), len(elements), 0
    while i < BINS:
        rounds = min(BINS - i, max(1, 1024 // n))
        h = mix64((elements[None, :] ^ _ROUNDS[i : i + rounds, None]).ravel())
        value = (h & np.uint64((1 << 57) - 1)) >> np.uint64(8)
        if i or rounds > 1:
            value |= np.repeat(np.arange(i, i + rounds, dtype=np.uint64) << np.uint64(49), n)
        np.minimum.at(bins, (h >> np.uint64(57)).astype(np.int64), value)
        i += rounds
        if not (bins == _EMPTY).any():
            return bins
    for j in np.flatnonzero(bins == _EMPTY):
        bins[j] = (np.uint64(BINS + int(j)) << np.uint64(49)) | (mix64(elements ^ _ROUNDS[BINS + j]).min() >> np.uint64(15))
    return bins


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(documents, 128) bins to (documents, 32) keys of four bins each; a key also holds its band's number."""
    rows = BINS // BANDS
    cut = sketches.reshape(len(sketches), BANDS, rows)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), cut.shape[:2]).copy()
    for i in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, i])
    return key


_SKETCHED = "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, signature binary"


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in sliced(batches, 1):
        sizes, prints, rows = [], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            s = shingle_set(text, hashes)
            sizes.append(len(s))
            prints.append(xxhash.xxh3_128_digest(s.tobytes()))
            rows.append(sketch(s) if len(s) else np.zeros(BINS, np.uint64))
        bins = np.array(rows, np.uint64).reshape(-1, BINS)
        two = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
        keys = band_keys(bins).view(np.int64)
        offsets = np.arange(0, BANDS * len(rows) + 1, BANDS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())), pa.array([x.tobytes() for x in (bins & np.uint64(255)).astype(np.uint8)], pa.binary())],
            names=["doc_id", "n_shingles", "set_a", "set_b", "keys", "signature"],
        )


def _confirm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (centre, part, member last); a centre's set is kept while its members pass."""
    hashes, centre, own = WordHashes(), None, np.empty(0, np.uint64)
    for batch in batches:
        found: list[tuple[int, int]] = []
        ids, parts, members, texts = (c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2), batch.column(3).cast(pa.binary())))
        for a, part, b, text in zip(ids, parts, members, texts, strict=True):
            if a == b:
                if (a, part) != centre:
                    centre, own = (a, part), shingle_set(text, hashes)
                continue
            if similar(own, shingle_set(text, hashes)):
                found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])


def _small(ids: DataFrame) -> DataFrame:
    """``ids`` (staged) marked for broadcast if they are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of distinct pairs ``(a, b)`` those whose full sets are similar enough.

    Each member's text travels once per pair and a centre's text once per ``BLOCK`` members, however many it has.
    """
    spread = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("n")), "a").select("a", "b", F.expr(f"pmod(xxhash64(b), (n + {BLOCK - 1}) div {BLOCK})").cast("int").alias("part"))
    asked = staged(spread.union(spread.select("a", F.col("a").alias("b"), "part").distinct()))
    held = docs.join(_small(asked), docs.doc_id == F.col("b")).select("a", "part", "b", "text")
    dealt = held.repartition("a", "part").sortWithinPartitions("a", "part", F.when(F.col("a") == F.col("b"), 0).otherwise(1), "b")
    return dealt.mapInArrow(_confirm_batches, "a long, b long").distinct()


def similar(own: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sorted sets are alike enough: 100 * intersection >= 75 * union."""
    if WHOLE * min(len(own), len(other)) < NEED * max(len(own), len(other)):
        return False
    union = np.concatenate([own, other])
    union.sort()
    joint = int((union[1:] == union[:-1]).sum())
    return WHOLE * joint >= NEED * (len(union) - joint)


class _Joined(dict):
    """Components that a block's links have joined so far: each to one that it was joined with, or itself."""

    def of(self, c: int) -> int:
        while c in self:
            c = self[c]
        return c

    def join(self, a: int, b: int) -> None:
        if a != b:
            self[max(a, b)] = min(a, b)


def _linking(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Similar pairs of one block that join components which weren't yet, confirmed on full sets, likeliest first for each stray.

    A pair is looked at in the first band that it shares.
    """
    if not len(left) or not len(right):
        return pd.DataFrame([], columns=["a", "b"], dtype=np.int64)
    hashes, sets, joined = WordHashes(), {}, _Joined()
    sl, sr = (np.frombuffer(b"".join(x.signature), np.uint8).reshape(-1, BINS) for x in (left, right))
    kl, kr = (np.stack(x["keys"].to_numpy()).astype(np.int64) for x in (left, right))
    ids, comp, key = right.doc_id.to_numpy(), right.component.to_numpy(), left.key.iloc[0]

    def of(side: pd.DataFrame, i: int) -> np.ndarray:
        doc = side.doc_id.iat[i]
        if doc not in sets:
            sets[doc] = shingle_set((side.text.iat[i] or "").encode(), hashes)
        return sets[doc]

    found: list[tuple[int, int]] = []
    for i, own in enumerate(left.component):
        agree = (sr == sl[i]).sum(1)
        hit = np.flatnonzero((agree >= LEAST_AGREE) & (comp != own))
        shared = kr[hit] == kl[i]
        hit = hit[kl[i][shared.argmax(1)] == key] if len(hit) else hit
        for j in hit[np.argsort(-agree[hit], kind="stable")]:
            a, b = joined.of(own), joined.of(comp[j])
            if a != b and similar(of(left, i), of(right, j)):
                found.append((min(left.doc_id.iat[i], ids[j]), max(left.doc_id.iat[i], ids[j])))
                joined.join(a, b)
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def _across(members: DataFrame, nodes: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Pairs ``(a, b)`` that join components of which one bucket holds members, None if there are no such buckets. Of any
    such pair at least one is a stray, outside its bucket's least component; strays are dealt into blocks and only they are
    compared with slices of the bucket's other members. Each block gives fewer pairs than it has members."""
    part = members.join(labels, members.doc_id == labels.node, "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = part.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n"))
    part = staged(part.join(mixed.where("least <> most and n > 2").select("key", "least"), "key"))
    ids = staged(part.select(F.col("doc_id").alias("_of")).distinct())
    if ids.isEmpty():
        return None
    own = nodes.join(_small(ids), F.col("doc_id") == F.col("_of"), "left_semi")
    texts = docs.select(F.col("doc_id").alias("_of"), "text").join(_small(ids), "_of", "left_semi").dropDuplicates(["_of"])
    signed = part.join(own, "doc_id").join(texts, F.col("doc_id") == F.col("_of")).drop("_of")
    cut = lambda rows, most: f"cast(greatest((count({rows}) + {most - 1}) div {most}, sum(if({rows}, n_shingles, 0)) div {BLOCK_SHINGLES} + 1) as int)"
    counts = part.join(own.select("doc_id", "n_shingles"), "doc_id").groupBy("key").agg(
        F.expr(cut("nullif(component <> least, false)", BLOCK)).alias("blocks"), F.expr(cut("true", SLICE)).alias("slices"))
    signed = signed.join(counts, "key")
    dealt = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = signed.where("component <> least").withColumn("block", dealt("blocks", 0)).withColumn("slice", each("slices"))
    right = signed.withColumn("slice", dealt("slices", 1)).withColumn("block", each("blocks"))
    left, right, on = left.toDF(*left.columns), right.toDF(*right.columns), ["key", "block", "slice"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(_linking, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Nulls, blank and empty texts have an empty set and are linked with nothing. Rows without an id are never linked
    and kept, with a null component. Repeated rows share a component; rows with one id count as one node. A table
    without rows gives none. Whole texts are sketched, however long, in memory that grows with the longest one. Other columns of ``docs``
    are not read, whatever their names.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketched = staged(docs.mapInArrow(_sketch_batches, _SKETCHED))
    full = sketched.where("n_shingles > 0 and doc_id is not null")
    # rows of equal sets have equal keys; of them only the node, the least id, goes on
    leaders = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("n_shingles", "signature", "keys"), "doc_id").alias("x"))
    nodes = staged(leaders.select("set_a", "set_b", F.col("node").alias("doc_id"), "x.*"))
    keyed = nodes.select("doc_id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("other")).where("centre <> other").select("key", "centre")
    members = staged(keyed.join(shared, "key").distinct())
    links = staged(confirmed(members.where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct(), docs))
    labels = components(links)
    more = _across(members.select("key", "doc_id"), nodes.drop("set_a", "set_b"), labels, docs)
    more = None if more is None else staged(more)
    if more is not None and not more.isEmpty():
        labels = components(links.union(more))
    sets = nodes.select("set_a", "set_b", F.col("doc_id").alias("node"))
    of_set = sets.join(labels, sets.node == labels.node, "left").select("set_a", "set_b", F.coalesce("component", sets.node).alias("least"))
    # members of one set share its node's component, whose least id may be the node itself
    out = sketched.join(of_set, (sketched.set_a == of_set.set_a) & (sketched.set_b == of_set.set_b) & (F.col("n_shingles") > 0), "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the document with the least id stays."""
    judged = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(judged, docs["doc_id"] == judged["dropped_id"], "left_anti")

