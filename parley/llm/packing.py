"""Packing documents into training sequences along a space-filling curve.

A document's hashed token vector is projected to ``DIMS`` dimensions by signs that hash from the token ids; each
coordinate becomes ``BITS`` bits and the Hilbert index of that cell is the document's place on the curve. Documents are
dealt to ranges of the curve (ties, such as exact copies, spread by a hash of the id), sorted within each range and
packed one after the other, cut wherever a sequence is full. What is left at a range's end becomes sequences of
powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.support import mix64, shuffle_partitions, sliced

LENGTH, DIMS, BITS = 1024, 4, 8
#: Ranges of the curve per shuffle partition, and keys of documents (by a hash) from which each range's bounds are estimated.
#: Other documents change the balance of ranges only, never the result's completeness.
RANGES, KEYS_A_RANGE = 4, 40
#: A text that has a run of so many blanks goes to the slower library: the faster one takes a time that grows with the square of each run, some
#: milliseconds for 2,000 blanks. Both give the same ids.
LONG_BLANKS = re.compile(r"\s{200}")
_TOKENIZER: dict = {}


def default_vocabulary() -> str:
    """The byte-level BPE with 50,257 ids, where the tokenizers' package is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str):  # noqa: ANN201
    """An encoder of texts to ids without special tokens, loaded once per worker.

    A byte-level BPE file of the ``tokenizers`` format is read as ranks and run by tiktoken, which gives the same ids
    several times faster (tests compare the two); texts with very long runs of blanks, which tiktoken can't match, and
    other files are run by ``tokenizers``.
    """
    if path not in _TOKENIZER:
        import json

        from tokenizers import Tokenizer

        made: list[Tokenizer] = []

        def slow(text: str) -> list[int]:
            if not made:  # it is seldom needed
                made.append(Tokenizer.from_file(path))
                made[0].encode_special_tokens = True
            return made[0].encode(text, add_special_tokens=False).ids

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        if model["model"]["type"] == "BPE" and (model.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not model["pre_tokenizer"].get("add_prefix_space") and not model.get("normalizer"):
            import public_tokenizers
            import tiktoken

            # the printable stand-ins of the 256 bytes in byte-level BPE files
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            other = [b for b in range(256) if b not in plain]
            byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
            special = {x["content"] for x in model.get("added_tokens", [])}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
            encoding = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            _TOKENIZER[path] = lambda text: slow(text) if LONG_BLANKS.search(text) else encoding.encode_ordinary(text)
        else:
            _TOKENIZER[path] = slow
    return _TOKENIZER[path]


def sign_table(size: int = 1 << 16) -> np.ndarray:
    """(size, DIMS) of +1 and -1 by a hash of the token id."""
    h = mix64(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (((h[:, None] >> np.arange(DIMS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1).astype(np.float32)


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indices of (n, dims) integer cells of ``bits`` bits (Skilling's transposition, for all rows at once)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(projected: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The place on the curve in the upper bits, 30 bits of a hash of the id below."""
    cells = np.clip((np.tanh(projected) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1)
    return (hilbert_index(cells) << 30) | salts


def _encoded(path: str, bounds: list[int] | None):  # noqa: ANN202
    """Rows (doc_id, text, salt) to (doc_id, key, bucket, ids of 4 bytes each, the closing id 0 included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, signs = tokenizer(path), sign_table()
        edges = np.array(bounds or [], np.int64)
        for batch in sliced(batches, 1):
            ids, projected = [], np.zeros((batch.num_rows, DIMS), np.float32)
            for i, text in enumerate(batch.column(1).to_pylist()):
                row = np.array(encode(text or "") + [0], np.uint32)
                ids.append(row.astype(np.uint16).tobytes() if row.max() < 1 << 16 else b"\xff" + row.tobytes())
                if len(row) > 1:
                    projected[i] = signs[row[:-1] & 0xFFFF].sum(0) / np.sqrt(len(row) - 1)
            keys = curve_keys(projected, batch.column(2).to_numpy())
            buckets = np.searchsorted(edges, keys, side="right").astype(np.int32)
            payload = pa.nulls(len(keys), pa.binary()) if bounds is None else pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(buckets), payload], names=["doc_id", "key", "bucket", "ids"])

    return run


def _ids(data: bytes) -> np.ndarray:
    """Two bytes an id where all fit, else four behind a marker byte (then the length is odd)."""
    return np.frombuffer(data, np.uint32, offset=1) if len(data) % 2 else np.frombuffer(data, np.uint16).astype(np.uint32)


def _powers(length: int) -> list[int]:
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, key): one run of ids per bucket, cut into sequences.

    Only the pieces of the open sequence are held back; where a bucket ends they are cut into powers of two.
    """
    names = [x.split()[0] for x in _PIECES.split(", ")]
    open_: list[tuple] = []
    filled, sequence, bucket = 0, 0, None
    out: list[tuple] = []

    def emit(pieces: list[tuple], number: int) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, offset))
            offset += len(ids)

    def close() -> None:
        """The rest of a bucket as sequences of powers of two."""
        nonlocal open_, filled, sequence
        rest = list(open_)
        for size in _powers(filled):
            own = []
            while size:
                doc, start, ids, total = rest.pop(0)
                own.append((doc, start, ids[:size], total))
                if len(ids) > size:
                    rest.insert(0, (doc, start + size, ids[size:], total))
                size -= len(own[-1][2])  # noqa: PLW2901
            emit(own, sequence)
            sequence += 1
        open_, filled = [], 0

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
        out.clear()
        return done

    for batch in batches:
        for doc, b, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if b != bucket:
                close()
                bucket, sequence = b, b << 40
            ids, at = _ids(data), 0
            while at < len(ids):
                take = min(LENGTH - filled, len(ids) - at)
                open_.append((doc, at, ids[at : at + take], len(ids)))
                at, filled = at + take, filled + take
                if filled == LENGTH:
                    emit(open_, sequence)
                    open_, filled, sequence = [], 0, sequence + 1
        yield flush()
    close()
    yield flush()


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per piece of a document: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every document has at least the closing id 0, so null and empty texts give one piece of length 1. Rows without
    an id and repeated rows are packed like any other. A sequence belongs to one range of the curve, and its id holds
    the range's number above the count within it. A table without rows gives none. Very long texts are encoded whole and cut into
    pieces; documents of one place on the curve (ties) lie by a hash of their id. Other columns are not read, whatever their names.
    """
    path = vocabulary or default_vocabulary()
    salted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(5)), 34).alias("salt"))
    schema = "doc_id long, key long, bucket int, ids binary"
    partitions = shuffle_partitions(docs.sparkSession)
    ranges = RANGES * partitions
    share = min(1.0, ranges * KEYS_A_RANGE / max(1, docs.count()))
    # one number per sampled document, so many for each range: they grow with the partitions, not with the documents
    sampled = salted.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    keys = np.sort(sampled.mapInArrow(_encoded(path, None), schema).select("key").toArrow().column("key").to_numpy())
    bounds = [int(x) for x in np.unique(keys[np.arange(1, ranges) * len(keys) // ranges])] if len(keys) else []
    dealt = salted.mapInArrow(_encoded(path, bounds), schema).repartition(partitions, "bucket").sortWithinPartitions("bucket", "key", "doc_id")
    return dealt.mapInArrow(_packed, _PIECES)
