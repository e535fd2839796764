"""Language-model scoring by online logistic context mixing.

Text is a sequence of tokens, each coded by binary decisions: a token among the ``VOCABULARY`` most frequent ones by its
Huffman path, any other by an escape. Every decision on a path is predicted by several contexts: none, the last very
frequent token, the last token, the last two, whose hashed counts come from all training texts, and by the decisions that
the text itself has taken at that place before. A gate, made of how much is known in the longer contexts, picks the weights
that add up the predictors' log odds. Weights start from fixed values (:func:`first_weights`) and are refined within each
text from its first tokens on, as are the text's own counts: nothing that a text is scored with has seen what comes after.

After an escape comes one more decision, whether the dictionary of all training tokens has the word: as likely as escaped
training tokens are found again when one occurrence is left out. If so, it costs its share of all escaped ones; the
dictionary is a table with a row per distinct token of the corpus, which Spark joins with the texts' words and no task holds
whole. If not, the word is spelled: its letters' decisions are predicted by the last one, three and four letters, counted
over the dictionary. All decisions form a prefix code, so the probabilities of all texts add up to at most one.

The hashed tables grow with the counted tokens up to ``MOST_SLOT_BITS``, which one worker's memory bounds; a slot that holds
more than its decision was ever seen with is shared, and counts as unknown.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.support import sliced, staged, text_slices

#: Tokens coded as a whole; all others are escaped, whatever their number.
VOCABULARY = 1 << 16
#: Hashed tables, their counters as a power of two, and training tokens for each counter before the table doubles.
HASHED, LEAST_SLOT_BITS, MOST_SLOT_BITS, TOKENS_A_SLOT = 3, 18, 21, 16
#: Predictors: none, the hashed tables, and for tokens the text's own counts.
PREDICTORS = HASHED + 2
#: Tokens of a text between two refinements of its weights, and its first refinements; tokens handled at once.
BLOCK, EARLY, CHUNK = 256, (16, 32, 64, 128, 256), 24_000
#: Distinct tokens of a task's own counts.
OWN_COUNTS = 400_000
#: Slots of own counts a decision, and for each piece of a text that is longer than a chunk.
OWN, OWN_LONG = 2, 1 << 19
RATE, STEADY, LEVELS = 2.4, 64, 4
GATES = LEVELS**HASHED
#: So many of the most frequent tokens tell what comes after them, their language above all.
TELLING = 64
END = "\n"
_PIECE = 8192
#: Log odds are held as 1/256 in the upper 12 bits, how much is known (0, 1, 2-3, 4-7 and so on) in the lower four.
_FINE, _MOST_ODDS = 256, 7.9


def _huffman(counts: list[int]) -> tuple[list[list[int]], list[list[int]]]:
    """Per symbol the inner nodes on its path from the root and the branches taken."""
    n = len(counts)
    heap = [(c, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, branch, new = {}, {}, n
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], branch[x], parent[y], branch[y] = new, 0, new, 1
        heapq.heappush(heap, (a + b, new))
        new += 1
    nodes, bits = [], []
    for i in range(n):
        path, taken, at = [], [], i
        while at in parent:
            taken.append(branch[at])
            at = parent[at]
            path.append(at - n)
        nodes.append(path[::-1])
        bits.append(taken[::-1])
    return nodes, bits


@dataclass
class Paths:
    """All symbols' paths end to end: where each starts, its length, and per decision the node, its hash, the branch and
    packed counts without context."""

    start: np.ndarray
    length: np.ndarray
    nodes: np.ndarray
    hashed: np.ndarray
    bits: np.ndarray
    plain: np.ndarray

    @classmethod
    def of(cls, counts: list[int]) -> Paths:
        nodes, bits = _huffman(counts)
        length = np.array([len(x) for x in nodes], np.int64)
        nodes, bits = (np.array([y for x in z for y in x], t) for z, t in ((nodes, np.int64), (bits, np.uint8)))
        taken = np.bincount(2 * nodes + bits, np.repeat(counts, length), 2 * len(counts)).reshape(-1, 2)
        plain = packed(*taken.T)[nodes]
        return cls(np.concatenate([[0], np.cumsum(length)[:-1]]), length, nodes, (nodes + 1).astype(np.uint32) * np.uint32(0x9E3779B1), bits, plain)

    def expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Path lengths of a sequence of symbols, and all their decisions' places in the arrays."""
        lengths = self.length[symbols]
        ends = np.cumsum(lengths)
        return lengths, np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[symbols] - (ends - lengths), lengths)


@dataclass
class Code:
    """Symbols by token (0 is the escape, 1 the end), the paths of tokens and bytes, and what is known without context."""

    words: list[bytes]
    tokens: Paths
    spelling: Paths
    slot_bits: int = LEAST_SLOT_BITS
    hashes: np.ndarray = field(repr=False, default=None)
    known: pa.Array = field(repr=False, default=None)

    @classmethod
    def of(cls, frequent: list[tuple[str, int]], total: int) -> Code:
        """From the most frequent tokens and their counts; ``total`` is that of all tokens."""
        words, counts = [w.encode() for w, _ in frequent if w != END], [n for w, n in frequent if w != END]
        end = dict(frequent).get(END, 0)
        letters = np.ones(256, np.int64)
        for w, n in zip(words, counts, strict=True):
            letters[np.frombuffer(w, np.uint8)] += 1 + n // 1000
        letters[32] += int(letters.sum() // 7)
        of_token = [max(1, total - end - sum(counts)), max(1, end), *counts]
        bits = int(np.clip((max(1, total) // TOKENS_A_SLOT).bit_length(), LEAST_SLOT_BITS, MOST_SLOT_BITS))
        spelling = Paths.of(letters.tolist())
        spelling.plain |= 15  # these few counts only shape the paths; the dictionary's letters outnumber them
        return cls(words, Paths.of(of_token), spelling, bits)

    def ready(self) -> Code:
        """With the look-ups that each worker builds for itself."""
        if self.known is None:
            self.known = pa.array(self.words, pa.large_binary())
            self.hashes = np.array([0, 1, *(xxhash.xxh32_intdigest(w) for w in self.words)], np.uint32)
        return self


def packed(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log odds and how much is known, in 16 bits."""
    odds = np.rint(np.clip(np.log((n1 + 0.3) / (n0 + 0.3)), -_MOST_ODDS, _MOST_ODDS) * _FINE).astype(np.int16)
    known = np.minimum(15, np.frexp((n0 + n1).astype(np.float64))[1]).astype(np.int16)
    return odds * np.int16(16) | known


#: Log odds of a text's own counts, each up to 15.
_N = np.arange(16)
_OWN_ODDS = np.log((_N[None, :] + 0.4) / (_N[:, None] + 0.4)).astype(np.float32).ravel()


def first_weights() -> np.ndarray:
    """(GATES, PREDICTORS): weights by how much the three hashed contexts know (nothing, little, some, much).

    Fixed values: the more the first context knows, the less counts without context weigh.
    """
    first, second, third = np.unravel_index(np.arange(GATES), (LEVELS,) * HASHED)
    rows = [
        np.array([0.40, 0.34, 0.24, 0.06])[first],
        np.array([0.06, 0.20, 0.38, 0.60])[first],
        np.array([0.04, 0.12, 0.20, 0.30])[second],
        np.array([0.04, 0.12, 0.20, 0.25])[third],
        np.full(GATES, 0.45),
    ]
    return np.stack(rows, 1).astype(np.float32)


#: A-Z to lower case, ASCII white space to blanks.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has (maximal runs without ASCII white space, A-Z lower-cased), and all of them as bytes."""
    column = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    _, ends, held = column.buffers()
    at = np.frombuffer(ends, np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer((held[int(at[0]) : int(at[-1])].to_pybytes() if held else b"").translate(_FOLD), np.uint8)
    at = at - at[0]
    solid = data != 32
    begins, closes = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    filled = at[:-1][np.diff(at) > 0], at[1:][np.diff(at) > 0] - 1
    for marks, places in zip((begins, closes), filled, strict=True):
        marks[places] = solid[places]
    starts = np.flatnonzero(begins)
    upto = np.concatenate([[0], np.cumsum(np.flatnonzero(closes) - starts + 1)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data[solid])])
    return np.diff(np.searchsorted(starts, at)), words


def word_hashes(words: pa.Array) -> np.ndarray:
    """32-bit hashes of words that aren't empty: their letters times powers by place, mixed."""
    if not len(words):
        return np.zeros(0, np.uint32)
    _, ends, held = words.buffers()
    at = np.frombuffer(ends, np.int64, len(words) + 1, 8 * words.offset)
    letters = np.frombuffer(held, np.uint8)[at[0] : at[-1]].astype(np.uint32)
    lengths = np.diff(at)
    powers = np.cumprod(np.full(int(lengths.max()), 0x01000193, np.uint32), dtype=np.uint32)
    h = np.add.reduceat((letters + np.uint32(1)) * powers.take(_places(lengths)), at[:-1] - at[0])
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    return h


@dataclass
class Tokens:
    """The tokens of some texts end to end, each text closed by the end token: symbols, hashes, where texts begin, and the
    escaped ones in order, as places in distinct words."""

    symbol: np.ndarray
    hashed: np.ndarray
    begin: np.ndarray
    rare: np.ndarray
    words: pa.Array

    @classmethod
    def of(cls, texts: pa.Array, code: Code) -> Tokens:
        lengths, flat = split_words(texts)
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        symbol = np.ones(begin[-1], np.int64)
        inside = np.ones(begin[-1], bool)
        inside[begin[1:] - 1] = False
        found = pc.index_in(flat, code.known)
        symbol[inside] = found.fill_null(-2).to_numpy(zero_copy_only=False) + 2
        escaped = flat.filter(found.is_null()).dictionary_encode()
        rare, words = escaped.indices.to_numpy(zero_copy_only=False), escaped.dictionary
        hashed = code.hashes[symbol]
        hashed[symbol == 0] = word_hashes(words)[rare]
        return cls(symbol, hashed, begin, rare, words)


@dataclass
class Carry:
    """What a text longer than a chunk takes from one piece to the next."""

    place: int = 0
    telling: int = 0
    one: int = 0
    two: int = 0
    moved: np.ndarray = None
    own: np.ndarray = None


@dataclass
class Decisions:
    """Decisions of some texts, by block and in a block by text: hashed slots, packed counts without context, branches and
    own slots (and their number); runs of one text in one block (their text, length, and where each block's end)."""

    slots: list[np.ndarray]
    plain: np.ndarray
    bit: np.ndarray
    own: np.ndarray = None
    own_slots: int = 0
    run_text: np.ndarray = None
    run_length: np.ndarray = None
    cuts: np.ndarray = None


def _mixed(node: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Hashes of decisions: nodes' hashes (left as they are) and contexts'."""
    h = node + context
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h


def _followed(x: np.ndarray, place: np.ndarray, back: int) -> np.ndarray:
    """The element ``back`` places earlier in the same text or word, else 0."""
    out = np.zeros_like(x)
    if len(x) > back:
        out[back:] = x[:-back]
    out[place < back] = 0
    return out


def _places(lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _blocks(place: np.ndarray) -> np.ndarray:
    """The block of a token by its place in the text: short ones first, then BLOCK tokens each."""
    late = place // BLOCK + len(EARLY) - 1
    return np.where(place < EARLY[-1], np.searchsorted(EARLY, place, "right"), late)


def _hashed_slots(node: np.ndarray, contexts: list[np.ndarray], lengths: np.ndarray, code: Code) -> list[np.ndarray]:
    return [(_mixed(node, np.repeat(c, lengths)) >> np.uint32(32 - code.slot_bits)).astype(np.int64) for c in contexts]


def decisions(symbol: np.ndarray, hashed: np.ndarray, lengths: np.ndarray, code: Code, carry: Carry | None = None, counting: bool = False) -> Decisions:
    """All decisions of some texts' tokens (``lengths``: how many each has), or of one piece of a long text, with its
    ``carry``, which moves on. For ``counting`` only slots and branches are needed."""
    text, place = np.repeat(np.arange(len(lengths)), lengths), _places(lengths)
    tells = np.where((symbol > 1) & (symbol < TELLING + 2), np.arange(len(symbol)), -1)
    tells = np.concatenate([[-1], np.maximum.accumulate(tells)[:-1]])
    telling = np.where(tells >= np.arange(len(symbol)) - place, symbol[tells], 0)
    one, two = _followed(hashed, place, 1), _followed(hashed, place, 2)
    if carry and carry.place:
        telling[tells < 0] = carry.telling
        one[0], two[0] = carry.one, carry.two
        two[1:2] = carry.one
    block = _blocks(place + (carry.place if carry else 0))
    block -= block[0]
    if carry:
        carry.place += len(symbol)
        now = np.flatnonzero((symbol > 1) & (symbol < TELLING + 2))
        carry.telling = int(symbol[now[-1]]) if len(now) else carry.telling
        carry.two, carry.one = (int(hashed[-2]) if len(symbol) > 1 else carry.one), int(hashed[-1])
    one = one * np.uint32(0xC2B2AE35)
    two = (one ^ two) * np.uint32(0x27D4EB2F) + np.uint32(2)
    contexts = [telling.astype(np.uint32) * np.uint32(0x165667B1) + np.uint32(3), one + np.uint32(1), two]
    if not counting:
        order = np.argsort(block.astype(np.uint16) if block[-1] < 1 << 16 and block.max() < 1 << 16 else block, kind="stable")
        symbol, text, block, contexts = symbol[order], text[order], block[order], [c[order] for c in contexts]
    paths = code.tokens
    of_token, at = paths.expand(symbol)
    node, bit = paths.hashed.take(at), paths.bits.take(at)
    slots = _hashed_slots(node, contexts, of_token, code)
    if counting:
        return Decisions(slots, None, bit)
    # each text has a range of own slots, which its decisions alone decide, so that neighbours don't matter
    n = np.bincount(text, of_token, len(lengths))
    size = np.full(len(lengths), OWN_LONG) if carry else np.int64(1) << np.ceil(np.log2(OWN * np.maximum(n, 8))).astype(np.int64)
    first = np.cumsum(size) - size
    own = _mixed(node, np.uint32(0))
    own ^= own >> np.uint32(13)
    own &= np.repeat((size - 1).astype(np.uint32)[text], of_token)
    starts = np.flatnonzero(np.diff(text, prepend=-1) | np.diff(block, prepend=-1))
    runs = np.add.reduceat(of_token, starts)
    return Decisions(slots, paths.plain.take(at), bit, np.repeat(first[text], of_token) + own, int(size.sum()), text[starts], runs, np.cumsum(np.bincount(block[starts])))


def spelled(words: list[bytes], code: Code) -> tuple[Decisions, np.ndarray]:
    """The decisions of some words' letters, each word closed by a blank, and where words begin."""
    letters = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    widths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    inner, wide = _places(widths), letters.astype(np.uint32)
    a, b, c, d = (_followed(wide, inner, k) for k in (1, 2, 3, 4))
    abc = a | b << np.uint32(8) | c << np.uint32(16)
    contexts = [a * np.uint32(0xC2B2AE35) + np.uint32(7), abc * np.uint32(0x27D4EB2F) + np.uint32(5), (abc | d << np.uint32(24)) * np.uint32(0x85EBCA6B) + np.uint32(9)]
    lengths, at = code.spelling.expand(letters.astype(np.int64))
    slots = _hashed_slots(code.spelling.hashed.take(at), contexts, lengths, code)
    return Decisions(slots, code.spelling.plain.take(at), code.spelling.bits.take(at)), (np.cumsum(lengths) - lengths)[np.cumsum(widths) - widths]


def chunks(tokens: Tokens, code: Code, counting: bool = False) -> Iterator[tuple[Decisions, slice, Carry | None]]:
    """Decisions of texts, about CHUNK tokens at a time, with the places of these texts; a longer text comes in pieces, with
    what it carries on."""
    begin, first = tokens.begin, 0
    while first < len(begin) - 1:
        upto = max(first + 1, int(np.searchsorted(begin, begin[first] + CHUNK, "right")) - 1)
        lo, hi = int(begin[first]), int(begin[upto])
        if hi - lo <= CHUNK:
            yield decisions(tokens.symbol[lo:hi], tokens.hashed[lo:hi], np.diff(begin[first : upto + 1]), code, None, counting), slice(first, upto), None
        else:
            carry = Carry()
            for at in range(lo, hi, CHUNK):
                end = min(at + CHUNK, hi)
                yield decisions(tokens.symbol[at:end], tokens.hashed[at:end], np.array([end - at]), code, carry, counting), slice(first, upto), carry
        first = upto


@dataclass
class Model:
    """Hashed tables of packed counts, by slot; first weights."""

    tables: list[np.ndarray]
    weights: np.ndarray = field(default_factory=first_weights)

    def _static(self, d: Decisions) -> tuple[list[np.ndarray], np.ndarray]:
        """The log odds of all predictors but the text's own counts, and their weighted sum."""
        least = d.plain & 15
        x, level = [(d.plain >> 4) * np.float32(1 / _FINE)], np.zeros(len(d.bit), np.uint8)
        for t, s in zip(self.tables, d.slots, strict=True):
            v = t.take(s)
            known = v & 15
            # a slot with more than its decision was ever seen with is shared
            level *= np.uint8(LEVELS)
            level += ((known > 0).view(np.uint8) + (known > 2) + (known > 5)) * (known <= least)
            x.append((v >> 4) * np.float32(1 / _FINE))
        gate = level.astype(np.int64)
        out = self.weights[:, 0].take(gate) * x[0]
        for k in range(1, PREDICTORS - 1):
            out += self.weights[:, k].take(gate) * x[k]
        return x, out

    def spell(self, words: list[bytes], code: Code) -> np.ndarray:
        """The natural log probability of each word by its letters."""
        out = []
        for lo in range(0, len(words), CHUNK // 8):
            d, begin = spelled(words[lo : lo + CHUNK // 8], code)
            z = self._static(d)[1] * (d.bit.astype(np.float32) * 2 - 1)
            out.append(np.add.reduceat(-np.log1p(np.exp(np.minimum(-z, np.float32(60)))), begin, dtype=np.float64))
        return np.concatenate(out) if out else np.zeros(0)

    def run(self, d: Decisions, texts: int, carry: Carry | None = None) -> np.ndarray:
        """The natural log probability of each text but for what follows its escapes.

        Own counts and what weights have moved by text go on block by block.
        """
        if carry and carry.own is None:
            carry.moved, carry.own = np.zeros((PREDICTORS, 1), np.float32), np.zeros(d.own_slots, np.int32)
        own, moved = (carry.own, carry.moved) if carry else (np.zeros(d.own_slots, np.int32), np.zeros((PREDICTORS, texts), np.float32))
        x, fixed = self._static(d)
        for_own = self.weights[0, -1]
        sign, one = d.bit.astype(np.float32) * 2 - 1, np.where(d.bit, np.int32(1 << 16), np.int32(1))
        out, lo, run = np.empty(len(d.bit), np.float32), 0, 0
        for upto in d.cuts:
            who, lengths = d.run_text[run:upto], d.run_length[run:upto]
            run = upto
            if not len(who):
                continue
            starts = np.cumsum(lengths) - lengths
            hi = lo + int(lengths.sum())
            at = d.own[lo:hi]
            seen = own.take(at)
            values = [v[lo:hi] for v in x]
            values.append(_OWN_ODDS.take(np.minimum(seen & 0xFFFF, 15) * 16 + np.minimum(seen >> 16, 15)))
            z = fixed[lo:hi] + for_own * values[-1]
            for k, v in enumerate(values):
                z += np.repeat(moved[k, who], lengths) * v
            z *= sign[lo:hi]
            right = 1 / (1 + np.exp(np.minimum(-z, np.float32(60))))
            error = sign[lo:hi] * (1 - right)
            out[lo:hi] = right
            share = np.float32(RATE) / (lengths + np.float32(STEADY))
            for k, v in enumerate(values):
                moved[k, who] += np.add.reduceat(error * v, starts) * share
            np.add.at(own, at, one[lo:hi])
            lo = hi
        if carry:  # counts stay below what half of an entry holds
            carry.own = np.minimum(own & 0xFFFF, 255) | np.minimum(own >> 16, 255) << 16
        logs = np.log(np.maximum(out, np.float32(1e-9)))
        return np.bincount(d.run_text, np.add.reduceat(logs, np.cumsum(d.run_length) - d.run_length), texts)


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def summed() -> pa.Table:
        return pa.Table.from_batches(held).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"])

    for batch in sliced(batches, 0):
        counted = split_words(batch.column(0))[1].value_counts()
        values, n = pa.concat_arrays([counted.field("values"), pa.array([END.encode()], pa.large_binary())]), pa.concat_arrays([counted.field("counts"), pa.array([batch.num_rows])])
        held.append(pa.RecordBatch.from_arrays([values.cast(pa.binary()).cast(pa.string()), n], names=["token", "n"]))
        size += len(n)
        if size > OWN_COUNTS:
            table = summed()
            held, size = table.combine_chunks().to_batches(), len(table)
            if 2 * size > OWN_COUNTS:
                yield from held
                held, size = [], 0
    if held:
        yield from summed().combine_chunks().to_batches()


def _coded(x: np.ndarray) -> bytes:
    """Counts in one byte each, larger ones behind them as (place, count)."""
    large = np.flatnonzero(x > 254)
    small = x.astype(np.uint8)
    small[large] = 255
    return small.tobytes() + np.stack([large, x[large]], 1).astype(np.int64).tobytes()


def _decoded(data: bytes) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, _PIECE).astype(np.int64)
    large = np.frombuffer(data, np.int64, offset=_PIECE).reshape(-1, 2)
    out[large[:, 0]] = large[:, 1]
    return out


_PIECES = "k int, piece int, counts binary"


def _pieces(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * (len(names) - 2)]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=names)


def _context_counts(sent, of_words: bool):  # noqa: ANN001, ANN202
    """Each task's own counts over its texts, or its words' letters, in pieces of _PIECE counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = sent.value.ready()
        size = 2 << code.slot_bits
        tables = [np.zeros(size, np.int32) for _ in range(HASHED)]
        for batch in batches:
            column = batch.column(0)
            if of_words:
                words = column.cast(pa.binary()).to_pylist()
                counted = (spelled(words[lo : lo + CHUNK // 8], code)[0] for lo in range(0, len(words), CHUNK // 8))
            else:
                counted = (d for rows in text_slices(column) for d, _, _ in chunks(Tokens.of(column[rows], code), code, counting=True))
            for d in counted:
                for t, s in zip(tables, d.slots, strict=True):
                    np.add.at(t, 2 * s + d.bit, np.int32(1))
        for k, t in enumerate(tables):
            cut = t.reshape(-1, _PIECE)
            yield _pieces([(k, int(i), _coded(cut[i])) for i in np.flatnonzero(cut.any(1))], ["k", "piece", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (k, piece) are added up one by one, and become log odds."""
    key, total, names = None, None, ["k", "piece", "odds"]
    done: list[tuple] = []

    def finish() -> None:
        done.append((*key, packed(*total.reshape(-1, 2).T).tobytes()))

    for batch in batches:
        for k, piece, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (k, piece):
                if key:
                    finish()
                key, total = (k, piece), np.zeros(_PIECE, np.int64)
            total += _decoded(counts)
        yield _pieces(done, names)
        done.clear()
    if key:
        finish()
    yield _pieces(done, names)


def context_odds(texts: DataFrame, words: DataFrame, code: Code) -> list[np.ndarray]:
    """The hashed tables over all ``texts`` and the letters of ``words``: packed counts by slot."""
    sent = texts.sparkSession.sparkContext.broadcast(code)
    pieces = texts.mapInArrow(_context_counts(sent, of_words=False), _PIECES).union(words.mapInArrow(_context_counts(sent, of_words=True), _PIECES))
    summed = pieces.repartition("k", "piece").sortWithinPartitions("k", "piece").mapInArrow(_added, "k int, piece int, odds binary")
    odds = [np.zeros(1 << code.slot_bits, np.int16) for _ in range(HASHED)]
    for batch in summed.toArrow().to_batches():
        for k, piece, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            odds[k][piece * _PIECE // 2 : (piece + 1) * _PIECE // 2] = np.frombuffer(data, np.int16)
    sent.destroy()
    return odds


_SCORED = "uid long, doc_id long, n_tokens long, n_bytes long, score double, base double, known long, token string, n long, spelled double"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.int64(), pa.float64())


def _scored(sent):  # noqa: ANN001, ANN202
    """Per text one row with its score and base sum but for escaped words, and one per distinct escaped word, with its score
    by letters if the text is held out; what the dictionary knows of words is looked up afterwards."""
    names = [x.split()[0] for x in _SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, model, logs = sent.value
        code.ready()
        for batch in sliced(batches, 3):
            if not batch.num_rows:
                continue
            texts = batch.column(3)
            tokens, uids, held, many = Tokens.of(texts, code), np.array(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False), batch.num_rows
            lengths = np.diff(tokens.begin)
            of, each = np.repeat(np.arange(many), lengths), logs[tokens.symbol]
            base, known = np.bincount(of, each, many), np.bincount(of[each > 0], minlength=many)
            scores = np.zeros(many)
            for d, at, carry in chunks(tokens, code):
                scores[at] += model.run(d, at.stop - at.start, carry)
            sizes = pc.binary_length(texts).fill_null(0).cast(pa.int64())
            columns = [pa.array(uids), batch.column(0), pa.array(lengths), sizes, pa.array(scores / np.log(10)), pa.array(base), pa.array(known)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(many, kind) for kind in _KINDS[7:])], names=names)
            if not len(tokens.rare):
                continue
            pairs, n = np.unique(of[tokens.symbol == 0] * len(tokens.words) + tokens.rare, return_counts=True)
            text, word = np.divmod(pairs, len(tokens.words))
            letters = np.full(len(tokens.words), np.nan)
            asked = np.unique(word[held[text]])
            letters[asked] = model.spell(tokens.words.take(pa.array(asked)).to_pylist(), code) / np.log(10)
            own = [pa.array(uids[text]), *(pa.nulls(len(text), kind) for kind in _KINDS[1:7])]
            yield pa.RecordBatch.from_arrays([*own, tokens.words.cast(pa.binary()).cast(pa.string()).take(pa.array(word)), pa.array(n), pa.array(letters[word], from_pandas=True)], names=names)

    return run


def lm_scores(docs: DataFrame, held_out: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    ``held_out`` (by default crc32(doc_id as text) mod 7 is 2) marks rows that nothing is learned from; rows without
    an id are learned from. A null or empty text is its end token alone. ``bits_per_byte`` are the score's total bits over
    the text's UTF-8 bytes and one for its end. Rows that share an id are scored each; a very long text is scored in pieces that
    carry on what it has learned; other columns are not read. A table without rows gives none; without training texts every count is 0.
    """
    spark = docs.sparkSession
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2 if held_out is None else held_out
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("held_out", F.coalesce(held, F.lit(False)))
    training = own.where("not held_out").select("text")
    counts = staged(training.mapInArrow(_token_counts, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")))
    total, distinct, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count(F.when(F.col("n") == 1, 1))).first()
    head = counts.orderBy(F.desc("n"), "token").limit(VOCABULARY).toArrow()
    frequent = list(zip(head.column("token").to_pylist(), head.column("n").to_pylist(), strict=True))
    escaped = total - sum(n for _, n in frequent)
    # of the training texts' escapes so many are found again when one occurrence is left out
    again = (escaped - (once - sum(n == 1 for _, n in frequent)) + 0.5) / (escaped + 1)
    code = Code.of(frequent, total)
    model = Model(context_odds(training, counts.where(F.col("token") != END).select("token"), code))
    by_token = dict(frequent)
    logs = np.log10(np.array([0, by_token.get(END, 0), *(by_token[w.decode()] for w in code.words)], np.float64) + 1)
    code.known = code.hashes = None
    sent = spark.sparkContext.broadcast((code, model, logs))
    rows = own.select("doc_id", F.monotonically_increasing_id().alias("uid"), "held_out", "text").mapInArrow(_scored(sent), _SCORED)
    # a text's own row gets a key that no token has, so that such rows spread over all partitions
    keyed = rows.withColumn("key", F.coalesce("token", F.concat(F.lit(END), F.col("uid").cast("string"))))
    found = keyed.join(counts.select(F.col("token").alias("key"), F.col("n").alias("c")), "key", "left")
    word = F.when(F.col("c").isNotNull(), F.log10(F.col("c") * (again / max(1, escaped)))).otherwise(F.col("spelled") + float(np.log10(1 - again)))
    sums = found.groupBy("uid").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "n_tokens", "n_bytes", "score", "base", "known")),
        F.sum(F.when(F.col("token").isNotNull(), F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).otherwise(0.0)).alias("rare"),
        F.sum(F.when(F.col("token").isNotNull(), F.col("n") * word).otherwise(0.0)).alias("words"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("found"),
    )
    base = F.col("base") + F.col("rare") - F.col("n_tokens") * float(np.log10(total + distinct + 1))
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2 if held_out is None else held_out
    score = F.col("score") + F.col("words")
    return sums.select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", (F.col("known") + F.col("found")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), (score * float(-np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
