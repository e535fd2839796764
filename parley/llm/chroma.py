"""Chroma audio fingerprints of a media column, and their alignment.

Samples become frames of energy per pitch class. Over the integral image of these frames (time by pitch class),
difference filters of several shapes slide in time; each gives two Gray-coded bits by how its halves compare, and all of
them make one packed 32-bit integer per position. Two recordings are compared at every offset by the share of differing bits.

Recordings with equal fingerprints become one class first. Queries are the rows whose id is divisible by 100; they
meet all classes, in groups of bounded size: a link may have a quarter of its bits wrong, and then seldom an integer, or
a part of one, in common, so that votes of equal parts either miss links or name most offsets of all pairs. Instead, the
bits of all offsets are compared at once by products of spectra, and what may be a link is counted bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.support import staged

RATE, WINDOW, HOP = 4000, 512, 128
LOWEST, HIGHEST = 110.0, 1760.0
#: Positions that a filter covers, and the loudness (of full scale) below which a position gives no integer.
SPAN, QUIET = 8, 1e-3
#: Aligned recordings share at least so many positions and differ in at most this share of their bits.
LEAST_OVERLAP, MOST_ERRORS = 8, 0.25
#: Recordings, and queries, that are compared in one group.
GROUP = 1024
#: 16 filters by rule: (shape, first pitch class, pitch classes, positions).
FILTERS = tuple((i % 4, (5 * i) % 12, 2 + (i // 4) * 2, SPAN if i % 2 else SPAN // 2) for i in range(16))
#: Where a filter's log ratio is cut into four levels.
CUTS = (-0.25, 0.0, 0.25)


def pcm_of(media: bytes | None) -> np.ndarray:
    """Samples between -1 and 1 of 16-bit mono PCM; the header of a WAV file is skipped. An odd last byte is ignored."""
    if not media:
        return np.empty(0)
    if media[:4] == b"RIFF" and media[8:12] == b"WAVE":
        at = 12
        while at + 8 <= len(media) and media[at : at + 4] != b"data":
            at += 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        media = media[at + 8 :]
    return np.frombuffer(media[: len(media) // 2 * 2], "<i2") / 32768


def _pitch_classes() -> np.ndarray:
    """(bins, 12): to which pitch class each frequency bin counts."""
    f = np.fft.rfftfreq(WINDOW, 1 / RATE)
    to = np.zeros((len(f), 12))
    inside = (f >= LOWEST) & (f <= HIGHEST)
    to[np.flatnonzero(inside), np.round(12 * np.log2(f[inside] / 440)).astype(int) % 12] = 1
    return to


_CLASSES, _HANN = _pitch_classes(), np.hanning(WINDOW)


def chroma(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, 12) energies, each frame of unit length, and the frames' loudness."""
    if len(samples) < WINDOW:
        samples = np.pad(samples, (0, WINDOW - len(samples)))
    frames = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]
    energy = (np.abs(np.fft.rfft(frames * _HANN, axis=1)) ** 2) @ _CLASSES
    loud = np.sqrt((frames**2).mean(1))
    return energy / np.maximum(np.linalg.norm(energy, axis=1, keepdims=True), 1e-12), loud


def fingerprint(media: bytes | None) -> np.ndarray:
    """One unsigned 32-bit integer per position; 0 where the recording is quiet. Too short ones have a single position."""
    samples = pcm_of(media)
    if not len(samples):
        return np.empty(0, np.uint32)
    image, loud = chroma(samples)
    if len(image) < SPAN:
        image, loud = (np.pad(x, [(0, SPAN - len(x))] + [(0, 0)] * (x.ndim - 1)) for x in (image, loud))
    # twice around the pitch classes, so that filters may wrap
    total = np.pad(np.cumsum(np.cumsum(np.hstack([image, image]), 0), 1), ((1, 0), (1, 0)))
    at = np.arange(len(image) - SPAN + 1)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[at + t1, p1] - total[at + t0, p1] - total[at + t1, p0] + total[at + t0, p0]

    out = np.zeros(len(at), np.uint32)
    for i, (shape, p, width, time) in enumerate(FILTERS):
        if shape == 0:  # earlier against later
            a, b = area(0, time // 2, p, p + width), area(time // 2, time, p, p + width)
        elif shape == 1:  # lower against upper
            a, b = area(0, time, p, p + width // 2), area(0, time, p + width // 2, p + width)
        elif shape == 2:  # two diagonals of quadrants
            h, w = time // 2, width // 2
            a, b = area(0, h, p, p + w) + area(h, time, p + w, p + width), area(h, time, p, p + w) + area(0, h, p + w, p + width)
        else:  # the middle against both sides
            q = time // 4
            a, b = area(q, time - q, p, p + width), area(0, q, p, p + width) + area(time - q, time, p, p + width)
        level = np.digitize(np.log((a + 0.05) / (b + 0.05)), CUTS).astype(np.uint32)
        out |= (level ^ (level >> np.uint32(1))) << np.uint32(2 * i)
    heard = np.lib.stride_tricks.sliding_window_view(loud, SPAN).max(1) >= QUIET
    return np.where(heard, np.maximum(out, np.uint32(1)), np.uint32(0))


def tones(vector: np.ndarray | None) -> bytes:
    """A vector as a melody in 16-bit PCM, a note per entry: for tables that hold no media of their own."""
    if vector is None or not len(vector):
        return b""
    x = np.nan_to_num(np.asarray(vector, np.float64))
    notes = np.round(x * 40).astype(int) % 36 - 12
    phase = np.cumsum(np.repeat(440 * 2 ** (notes / 12), HOP)) / RATE
    return (np.sin(2 * np.pi * phase) * 16000).astype("<i2").tobytes()


def _fingerprinted(decode):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(decode(x) if decode else x) for x in batch.column(1).to_pylist()]
            pair = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p.tobytes()) for p in prints), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p.astype(np.int64).tolist() for p in prints], pa.list_(pa.int64())), pa.array(pair[:, 0]), pa.array(pair[:, 1])],
                names=["id", "prints", "class_a", "class_b"],
            )

    return run


_LINK = "q_id long, o_id long, offset long, votes long, overlap long, bit_error double"
#: A bit that is heard counts 1 if it is set, else -1; with a channel of what is heard, weighed so, the sum over an offset of a link reaches
#: ``LEAST_OVERLAP``, and that of positions without anything heard is 0.
_HEARD = 32 * (1 - 2 * MOST_ERRORS) - 1
#: Bytes that the spectra of a slice of recordings, and the sums of a tile of pairs, may take.
_SLICE, _TILE = 24_000_000, 8_000_000


def _fast_length(n: int) -> int:
    """The least product of 2, 3 and 5 that is no less than ``n``."""
    return min(x * 2 ** max(0, (-(-n // x) - 1).bit_length()) for x in (3**i * 5**j for i in range(12) for j in range(8)))


def _spectra(prints: list[np.ndarray], length: int, heard: float) -> np.ndarray:
    """(recordings, 33, frequencies) of their bits as 1 and -1, and of what is heard times ``heard``, padded to ``length``."""
    flat = np.concatenate(prints)
    there = (flat > 0).astype(np.float32)[:, None]
    bits = np.unpackbits(flat.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").astype(np.float32)
    every = np.hstack([(2 * bits - 1) * there, there * np.float32(heard)])
    x, ends = np.zeros((len(prints), 33, length), np.float32), np.cumsum([len(p) for p in prints])
    for row, p, end in zip(x, prints, ends, strict=True):
        row[:, : len(p)] = every[end - len(p) : end].T
    return np.fft.rfft(x, axis=2)


def _slices(prints: list[np.ndarray], longest: int) -> Iterator[slice]:
    """Slices of recordings, which come by length, whose spectra at once take about ``_SLICE`` bytes beside one of length ``longest``."""
    first = 0
    for i in range(1, len(prints) + 1):
        if i == len(prints) or (i + 1 - first) * 33 * 4 * (len(prints[i]) + longest) > _SLICE:
            yield slice(first, i)
            first = i


def _near(queries: list[np.ndarray], others: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """Query, other and offset wherever bits may differ in few enough places; both come by length.

    The agreement of two recordings at all offsets is a correlation, so a product of spectra; summed over bits, that is a product of matrices
    for each frequency. Its sums are whole numbers but for rounding, for which there is room.
    """
    for a in _slices(queries, max(map(len, others))):
        own, at = queries[a], None
        for b in _slices(others, len(own[-1])):
            there = others[b]
            most = len(there[-1])
            # offsets that share too little may fall on others, nothing else does
            length = _fast_length(max(len(own[-1]) + most - LEAST_OVERLAP, len(own[-1]), most))
            if at != length:
                at, left = length, np.ascontiguousarray(np.conj(_spectra(own, length, 1.0)).transpose(2, 0, 1))
            right = np.ascontiguousarray(_spectra(there, length, -_HEARD).transpose(2, 1, 0))
            least = LEAST_OVERLAP - 0.5 - 1e-5 * (32 + _HEARD) * min(len(own[-1]), most)
            side = max(1, int((_TILE / 4 / length) ** 0.5))
            for i in range(0, len(own), side):
                for j in range(0, len(there), side):
                    product = np.ascontiguousarray(np.matmul(left[:, i : i + side], right[:, :, j : j + side]).transpose(1, 2, 0))
                    sums = np.fft.irfft(product, length, axis=2)
                    for q, o, k in zip(*(x.tolist() for x in np.unravel_index(np.flatnonzero(sums >= least), sums.shape)), strict=True):
                        yield a.start + i + q, b.start + j + o, k if k <= most - LEAST_OVERLAP else k - length


def _compared(others: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """Per query and other recording the best of all offsets that make a link: most equal integers, fewest errors, nearest to 0.

    What :func:`_near` finds is counted bit by bit.
    """

    def long_enough(rows: pd.DataFrame) -> tuple[list, list[np.ndarray]]:
        kept = sorted(((len(p), i, np.asarray(p, np.int64).astype(np.uint32)) for i, p in zip(rows["id"], rows["prints"], strict=True) if len(p) >= LEAST_OVERLAP), key=lambda x: x[:2])
        return [i for _, i, _ in kept], [p for _, _, p in kept]

    (ids, prints), (asked, own) = long_enough(others), long_enough(queries)
    best: dict[tuple[int, int], tuple] = {}
    for q, o, offset in _near(own, prints) if ids and asked else ():
        if asked[q] == ids[o]:
            continue
        a, b = own[q][max(0, -offset) :], prints[o][max(0, offset) :]
        n = min(len(a), len(b))
        a, b = a[:n], b[:n]
        heard = (a > 0) & (b > 0)
        overlap, errors = int(heard.sum()), int(np.bitwise_count((a ^ b)[heard]).sum(dtype=np.int64))
        if overlap < LEAST_OVERLAP or errors > 32 * MOST_ERRORS * overlap:
            continue
        votes, error = int(((a == b) & heard).sum()), errors / (32 * overlap)
        rank = (votes, -error, -abs(offset), offset)
        if (q, o) not in best or rank > best[q, o][0]:
            best[q, o] = (rank, (asked[q], ids[o], offset, votes, overlap, error))
    return pd.DataFrame([row for _, row in best.values()], columns=[c.split()[0] for c in _LINK.split(", ")])


def match_recordings(media: DataFrame, media_id: str, content: str, decode=None, every: int = 100) -> DataFrame:  # noqa: ANN001
    """Rows ``id, class_id, class_size, n_prints, is_query, links``, one per recording.

    ``class_id`` is the least id with the same fingerprint and ``class_size`` their number. ``links`` of a query (an id
    divisible by ``every``) lists the other classes it aligns with: class id, offset in positions (theirs minus ours),
    votes (equal integers there), overlap and bit error. ``content`` is a binary column of PCM or WAV, or what ``decode`` turns into that.
    Null, empty and quiet recordings have no integers to share and no links; those form one class each. Ids must not
    be null to take part; rows that share an id are recordings of their own. A table without rows gives none. A long recording is
    one row and is held in memory; other columns than the two are not read, whatever their names.
    """
    rows = media.select(F.col(media_id).cast("long").alias("id"), F.col(content).alias("content"))
    found = staged(rows.mapInArrow(_fingerprinted(decode), "id long, prints array<long>, class_a long, class_b long"))
    sizes = staged(found.where("id is not null").groupBy("class_a", "class_b").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"), F.max(F.expr(f"id % {every} = 0")).alias("asked")))
    first = found.join(sizes.select(F.col("class_id").alias("id"), "class_a", "class_b", "asked"), ["id", "class_a", "class_b"]).dropDuplicates(["id", "class_a", "class_b"])
    classes = staged(first.select("id", "prints", "asked"))
    n_all, n_asked = classes.agg(F.count("*"), F.count(F.when(F.col("asked"), 1))).first()
    blocks, parts = -(-n_all // GROUP) or 1, -(-n_asked // GROUP) or 1

    def dealt(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        each = rows.select("id", "prints", F.pmod(F.xxhash64("id"), F.lit(n_own)).alias(own))
        return each.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)).cast("array<long>"))).repartition(min(blocks * parts, 4096), "block", "part")

    others, asked = dealt(classes, "block", blocks, "part", parts), dealt(classes.where("asked"), "part", parts, "block", blocks)
    good = others.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(_compared, _LINK)
    links = good.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct(F.col("o_id").alias("class_id"), "offset", "votes", "overlap", F.round("bit_error", 6).alias("bit_error")))).alias("links"))
    listed = found.join(sizes.drop("asked"), ["class_a", "class_b"], "left").join(links, F.col("class_id") == F.col("q_id"), "left")
    query = F.coalesce(F.expr(f"id % {every} = 0"), F.lit(False))
    return listed.select("id", "class_id", "class_size", F.size("prints").cast("long").alias("n_prints"), query.alias("is_query"), F.when(query, F.col("links")).alias("links"))
