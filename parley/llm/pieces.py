"""SentencePiece encoding with the bytes that each piece stands for, and decoding.

A text is normalised by the model's compiled character map: at each place the longest key of its double-array trie is
replaced, or else one character taken over, and each normalised byte remembers its place in the original. Pieces are
merged over the normalised text, best score first; their bounds are projected through that alignment.

Merges stay within stretches that no piece of the vocabulary spans (here words with the blanks before them), so that a
stretch is merged once a worker and then remembered.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parley.llm.support import sliced

SPACE = "▁"
_SPACE, _UNKNOWN_CHAR = SPACE.encode(), "�".encode()
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Stretches that a worker remembers, and their greatest length in characters; others are merged each time.
REMEMBERED, LONGEST = 400_000, 48
#: Up to so many characters a stretch is merged by scans, beyond by a heap; the results are the same.
SHORT = 64
_NO_PIECE = float("-inf")

#: The place in the original of each of some places in the normalised text.
Projection = Callable[[np.ndarray], np.ndarray]


def default_model() -> str:
    """The 32k model with byte fallback, where the tokenizers' package is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharacterMap:
    """A compiled character map: the size of a trie of 32-bit units, the trie, and replacements that end with a zero byte."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that ``text`` continues with."""
        offset = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
        found, node = None, offset(self.units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= offset(unit)
            if unit & 0x100:
                found = self.units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        start, length = found
        return self.replacements[start : self.replacements.index(b"\0", start)], length


def _character(text: bytes, at: int) -> tuple[bytes, int]:
    """The character at a place, or the replacement character for a byte that begins none."""
    for n in (1, 2, 3, 4):
        try:
            text[at : at + n].decode()
            return text[at : at + n], n
        except UnicodeDecodeError:
            pass
    return _UNKNOWN_CHAR, 1


class Normalizer:
    """Texts as a model sees them, with an alignment to the original bytes."""

    def __init__(self, spec) -> None:  # noqa: ANN001
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.space = spec.add_dummy_prefix, spec.remove_extra_whitespaces, _SPACE if spec.escape_whitespaces else b" "

    def __call__(self, text: bytes) -> tuple[bytes, Projection]:
        if text and not self.map.units and not self.squeeze and self.space == _SPACE:
            try:
                text.decode()
                return self._unmapped(text)
            except UnicodeDecodeError:
                pass
        return self._mapped(text)

    def _unmapped(self, text: bytes) -> tuple[bytes, Projection]:
        """Without a map only blanks change their width: a place moves by the blanks before it."""
        before = len(_SPACE) if self.dummy else 0
        blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
        blanks += before + 2 * np.arange(len(blanks))
        return _SPACE * self.dummy + text.replace(b" ", _SPACE), lambda at: np.maximum(at - before - 2 * np.searchsorted(blanks, at), 0)

    def _mapped(self, text: bytes) -> tuple[bytes, Projection]:
        out, places, at, after_space = bytearray(), [], 0, self.squeeze

        def put(new: bytes) -> None:
            out.extend(new)
            places.extend([at] * len(new))

        started = False
        while at < len(text):
            new, length = (self.map.longest(text, at) if self.map.units else None) or _character(text, at)
            if after_space:
                new = new.lstrip(b" ")
            if new or not after_space:
                if not started and self.dummy:
                    put(self.space)
                started = True
                for b in new:
                    put(self.space if b == 0x20 else bytes((b,)))
                after_space = self.squeeze and new.endswith(b" ")
            at += length
        if self.squeeze:
            while out.endswith(self.space):
                del out[-len(self.space) :]
                at = places[-len(self.space)]
                del places[-len(self.space) :]
        aligned = np.array([*places, at], np.int64)
        return bytes(out), lambda x: aligned[x]


class Pieces(dict):
    """A model of merged pieces with byte fallback; as a mapping, stretches of normalised text to the ids of their pieces (packed)."""

    def __init__(self, model: bytes) -> None:
        super().__init__()
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        kinds = [p.type for p in proto.pieces]
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE} or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models of merged pieces with byte fallback are supported, without user-defined and unused pieces")
        self.normalize = Normalizer(proto.normalizer_spec)
        self.begin, self.end = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.of_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        surfaces = {NORMAL: lambda p: p.piece.replace(SPACE, " ").encode(), BYTE: lambda p: bytes((int(p.piece[3:5], 16),)), CONTROL: lambda p: b"", UNKNOWN: lambda p: proto.trainer_spec.unk_surface.encode()}
        self.surfaces = [surfaces[p.type](p) for p in proto.pieces]
        self.kinds = kinds
        self.spaced = [p.type == NORMAL and p.piece.startswith(SPACE) for p in proto.pieces]
        self.strips = proto.normalizer_spec.add_dummy_prefix or proto.normalizer_spec.remove_extra_whitespaces
        self.lengths = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        joined = "".join(p for p in self.ids if len(p) > 1)
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in joined)
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        own = f"|[{alone}]+" if alone else ""
        self.stretches = (lambda text: [text]) if inner else re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+{own}").findall

    def __missing__(self, stretch: str) -> bytes:
        found = struct.pack(f"<{len(x := self.merged(stretch))}I", *x)
        if len(stretch) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[stretch] = found
        return found

    def merged(self, stretch: str) -> list[int]:
        """Ids of a stretch of normalised text: neighbours that make the piece of the best score are merged first, then the leftmost ones."""
        out: list[int] = []
        for p in self._short(stretch) if len(stretch) <= SHORT else self._long(stretch):
            out += [self.ids[p]] if p in self.ids else [self.of_byte[x] for x in p.encode()]
        return out

    def _short(self, stretch: str) -> list[str]:
        """Merges by a scan over all neighbours each time."""
        parts, score = list(stretch), self.scores.get
        pairs = [score(a + b, _NO_PIECE) for a, b in zip(parts, parts[1:])]  # noqa: B905, RUF007
        while pairs and (best := max(pairs)) > _NO_PIECE:
            i = pairs.index(best)
            joined = parts[i] = parts[i] + parts[i + 1]
            del parts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + joined, _NO_PIECE)
            if i < len(pairs):
                pairs[i] = score(joined + parts[i + 1], _NO_PIECE)
        return parts

    def _long(self, stretch: str) -> Iterator[str]:
        """The same by a heap of neighbours, in a time that grows little faster than the stretch."""
        parts: list[str] = list(stretch)
        n = len(parts)
        left, right, heap, scores = list(range(-1, n - 1)), list(range(1, n + 1)), [], self.scores

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (score := scores.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-score, a, b, len(parts[a]) + len(parts[b])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, length = heapq.heappop(heap)
            if not parts[a] or not parts[b] or right[a] != b or len(parts[a]) + len(parts[b]) != length:
                continue
            parts[a], parts[b] = parts[a] + parts[b], ""
            right[a] = right[b]
            if right[b] < n:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return filter(None, parts)

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with begin and end ids, and the first byte and the end of what each stands for in ``text``."""
        if not text:
            return np.array([self.begin, self.end], "<u4"), np.zeros(2, "<u4"), np.zeros(2, "<u4")
        normal, project = self.normalize(text)
        ids = np.frombuffer(b"".join(map(self.__getitem__, self.stretches(normal.decode()))), "<u4")
        bounds = project(np.concatenate(([0], np.cumsum(self.lengths[ids])))).astype("<u4")
        ends = np.array([0, len(text)], "<u4")
        return tuple(np.concatenate(x).astype("<u4") for x in (([self.begin], ids, [self.end]), (ends[:1], bounds[:-1], ends[1:]), (ends[:1], bounds[1:], ends[1:])))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of some ids: pieces' surfaces without the first blank, bytes as they are; bytes that make no character become
        replacement characters."""
        ids = ids.tolist()
        out = b"".join(map(self.surfaces.__getitem__, ids))
        try:
            out.decode()
        except UnicodeDecodeError:
            out = self._mended(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return out[1:] if self.strips and first is not None and self.spaced[first] else out

    def _mended(self, ids: list[int]) -> bytes:
        out, run = bytearray(), bytearray()

        def close() -> None:
            at = 0
            while at < len(run):
                new, n = _character(bytes(run[at : at + 4]), 0)
                out.extend(new)
                at += n
            run.clear()

        for i in ids:
            if self.kinds[i] == BYTE:
                run.extend(self.surfaces[i])
            else:
                close()
                out.extend(self.surfaces[i])
        close()
        return bytes(out)


_LOADED: dict[int, Pieces] = {}


def _shared(spark: SparkSession, model: str | None) -> Callable[[], Pieces]:
    """The model in a task, loaded once per worker; its file is read by the driver and sent along, some hundred kilobytes."""
    with open(model or default_model(), "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def load() -> Pieces:
        name = zlib.crc32(sent.value)
        if name not in _LOADED:
            _LOADED[name] = Pieces(sent.value)
        return _LOADED[name]

    return load


def _key(df: DataFrame) -> str:
    return f"doc_id {df.schema['doc_id'].dataType.simpleString()}"


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids, starts, ends`` of each row of ``docs`` (``doc_id, text``): all ids with begin and end, and the bytes of the
    UTF-8 text that each of them stands for, from ``starts`` up to ``ends``. The three lists are packed as little-endian unsigned 32-bit
    integers. The spans of a text follow each other without gaps and cover it; begin, end and a blank put before the text are empty.

    Null texts count as empty ones, which have the begin and end ids only. Each row is encoded by itself, so that repeated rows and ids (ties)
    give equal results and null ids stay; bytes that are no UTF-8 count as replacement characters. Whole texts are encoded, however long, in
    memory that grows with the longest one. An empty table gives no rows. Columns other than ``doc_id`` and ``text`` are not looked at.
    """
    load = _shared(docs.sparkSession, model)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load()
        for batch in sliced(batches, 1):
            rows = [pieces.encode(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            found = [[x.tobytes() for x in column] for column in zip(*rows, strict=True)] or [[], [], []]
            n = pa.array([len(x) // 4 for x in found[0]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, *(pa.array(x, pa.binary()) for x in found)], ["doc_id", "n_tokens", "ids", "starts", "ends"])

    return docs.select("doc_id", "text").mapInArrow(encoded, f"{_key(docs)}, n_tokens long, ids binary, starts binary, ends binary")


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of rows with packed ``ids``. Null or empty lists give empty texts; begin and end ids give nothing;
    repeated rows are decoded each; an empty table gives no rows."""
    load = _shared(encoded.sparkSession, model)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load()
        for batch in sliced(batches, 1):
            ids = batch.column(1).to_pylist()
            texts = [pieces.decode(np.frombuffer(x or b"", "<u4")) for x in ids]
            n = pa.array([len(x or b"") // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, batch.column(1), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, f"{_key(encoded)}, n_tokens long, ids binary, decoded string")
