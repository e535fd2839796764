"""Repair of conversations' turn structure at least cost.

The roles of a conversation must read ``(s?(ua)+)?``: a system turn or none, then user and assistant in turns. A backward
pass over its turns gives for each turn and each state of that grammar the cost of the cheapest repair from there on; a
forward walk from the start then takes at each place the least letter, in ASCII, among the edits that are tight in these
costs, and so finds the least of all cheapest audits.

Costs of the four states differ by a few units only, however long the conversation is. The pass therefore keeps one byte a
turn: the number of the vector of differences. It runs over narrow rows (a symbol a turn), sorted by Spark, without texts;
a second pass streams the texts along the finished audit. What a task holds of a conversation are bytes as many as its
turns, as the audit itself has; a repaired text is hashed turn by turn, never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BLANK_CHARS = r"\x20\x09-\x0D"
_TRIMMED = " \t\n\x0b\x0c\r"
#: What an edit costs; a truncated turn that stays costs ``TRUNCATED`` more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
INITIALS = "sua"
#: States of the grammar: nothing yet, after the system's, the user's, the assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state that an inserted turn or one of a new role leads to, by the state before.
_WANTED = (USER, USER, ASSISTANT, USER)
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: Faults of a turn, the first of which counts; turns that are gone are only there for their conversation's sake.
SOUND, BLANK, DUPLICATE, TRUNC, GONE = range(5)
_NEVER = 1 << 40
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: Conversations, or bytes of audits and texts, after which a task hands on what it has.
_BATCH_ROWS, _BATCH_BYTES = 2_000, 2_000_000

Costs = tuple[int, int, int, int]


def initial_of(role: str) -> str:
    return role[:1] if role[:1] in tuple(INITIALS) else "?"


def _inserted(costs: list[int]) -> Costs:
    """Costs of the four states where turns may be inserted first."""
    start, system, user, assistant = costs
    user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return min(start, INSERT + user), min(system, INSERT + user), user, assistant


AT_END = _inserted([0, _NEVER, _NEVER, 0])


def _edits(initial: str, fault: int, state: int, after: Costs) -> Iterator[tuple[str, int, int]]:
    """Letter, cost-to-go and next state of each edit of a turn, in ASCII order."""
    yield "D", DELETE + after[state], state
    if fault in (BLANK, DUPLICATE):
        return
    extra = TRUNCATED if fault == TRUNC else 0
    if (state, initial) in _KEPT:
        yield "K", KEEP + extra + after[_KEPT[state, initial]], _KEPT[state, initial]
    yield "R", REROLE + extra + after[_WANTED[state]], _WANTED[state]


def _costs(initial: str, fault: int, after: Costs) -> Costs:
    return _inserted([min(cost for _, cost, _ in _edits(initial, fault, q, after)) for q in range(4)])


@cache
def cost_before(initial: str, fault: int, after: Costs) -> tuple[Costs, int]:
    """The costs before a turn, from those after it: their differences from the least one, and that one."""
    costs = _costs(initial, fault, after)
    return tuple(c - min(costs) for c in costs), min(costs)


@cache
def choice(initial: str, fault: int, after: Costs, state: int) -> tuple[str, int]:
    """The least letter among the tight edits at a turn, and the next state."""
    costs = _costs(initial, fault, after)
    edits = [*_edits(initial, fault, state, after), ("I", INSERT + costs[_WANTED[state]], _WANTED[state])]
    letter, _, to = min(e for e in edits if e[1] == costs[state])
    return letter, to


#: A turn's symbol: its initial and fault as one byte.
def symbol(initial: str, fault: int) -> int:
    return ("sua?".index(initial) << 3) | fault


def _of_symbol(x: int) -> tuple[str, int]:
    return "sua?"[x >> 3], x & 7


def cheapest_audit(symbols: bytes) -> tuple[int, str]:
    """Cost and least audit of a conversation, given as a symbol a turn."""
    numbers, vectors, back = {AT_END: 0}, [AT_END], bytearray(len(symbols) + 1)
    at, cost = AT_END, 0
    for i in range(len(symbols) - 1, -1, -1):
        at, least = cost_before(*_of_symbol(symbols[i]), at)
        cost += least
        if at not in numbers:
            numbers[at] = len(vectors)
            vectors.append(at)
        back[i] = numbers[at]
    cost += at[START]
    state, audit = START, bytearray()
    for i, x in enumerate(symbols):
        after, letter = vectors[back[i + 1]], "I"
        while letter == "I":
            letter, state = choice(*_of_symbol(x), after, state)
            audit += letter.encode()
    while AT_END[state]:
        audit += b"I"
        state = _WANTED[state]
    return cost, audit.decode()


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: turns damaged by ``crc32(conv_id:turn) % 20``, nulls as one space: 0 drops the turn
    (``gone`` is true and the row stays for its conversation's sake), 1 empties its text, 2 removes ``.``, ``!`` and ``?`` from it, 3 repeats
    the turn, 4 sets the role ``user``."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), (F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), "kind")
    return rows.withColumn("copy", F.explode(F.expr("array_repeat(0, if(kind = 3, 2, 1))"))).drop("kind", "copy")


def _digest() -> Column:
    """Of role and text; it orders turns of one number."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _symbols(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, symbol``, sorted within partitions that hold whole conversations."""
    initial = F.substring("role", 1, 1)
    first = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    last = F.expr(f"right(trim(trailing '{_TRIMMED}' from text), 1)")
    fault = F.when(F.col("gone"), GONE).when(~F.col("text").rlike(f"[^{BLANK_CHARS}]"), BLANK).when(~last.isin(".", "!", "?"), TRUNC).otherwise(SOUND)
    narrow = rows.select("conv_id", "turn", "gone", _digest().alias("digest"), first.alias("first"), fault.alias("fault")).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "digest", "gone").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when((F.col("seen") > 1) & F.col("fault").isin(SOUND, TRUNC), DUPLICATE).otherwise(F.col("fault"))
    narrow = narrow.withColumn("seen", seen).select("conv_id", "turn", "digest", "seen", (F.col("first") * 8 + fault).cast("int").alias("symbol"))
    return narrow.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest", "seen").select("conv_id", "turn", "symbol")


def _flushed(schema: pa.Schema) -> tuple[Callable, Callable]:
    """``add(row, bytes)``, which gives a batch when enough rows are there or else none, and ``rest()``."""
    kept: list[tuple] = []
    held = [0]

    def rest() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True) if kept else [[]] * len(schema), schema, strict=True)], schema=schema)
        kept.clear()
        held[0] = 0
        return batch

    def add(row: tuple, n: int) -> list[pa.RecordBatch]:
        kept.append(row)
        held[0] += n
        return [rest()] if len(kept) >= _BATCH_ROWS or held[0] >= _BATCH_BYTES else []

    return add, rest


class _Tally:
    """What the turns of one conversation add up to, in their order."""

    def __init__(self) -> None:
        self.symbols, self.illegal, self.before = bytearray(), 0, None
        self.least = self.last = None
        self.turns = 0

    def add(self, turn: int | None, x: int) -> None:
        if x & 7 == GONE:
            return
        self.symbols.append(x)
        if turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.last, self.turns = turn, self.turns + 1
        initial = "sua?"[x >> 3]
        self.illegal += self.before is not None and (self.before, initial) not in _LEGAL
        self.before = initial

    def row(self) -> tuple:
        faults = [sum(self.symbols.count((i << 3) | fault) for i in range(4)) for fault in (BLANK, DUPLICATE, TRUNC)]
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        cost, audit = cheapest_audit(bytes(self.symbols))
        return gaps, *faults, self.illegal, cost, audit


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def audits(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of conversations given as ``conv_id, turn, role, text, gone``.

    See :func:`repairs` for what odd rows give.
    """
    schema = T.StructType([rows.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType())])
    arrow = _arrow_schema(schema)

    def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, rest = _flushed(arrow)
        tally, conv = None, None
        for batch in batches:
            for of, turn, x in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "symbol")), strict=True):
                if tally is None or of != conv:
                    if tally:
                        yield from add((conv, *tally.row()), len(tally.symbols))
                    tally, conv = _Tally(), of
                tally.add(turn, x)
        if tally:
            yield from add((conv, *tally.row()), len(tally.symbols))
        yield rest()

    return _symbols(rows).mapInArrow(audited, schema)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple | None, str, str]]:
    """Conversations turn by turn as they are after repair: first ``(conv_id, counts..., audit)`` with empty role and text, then ``None`` with
    each role and text. Rows come sorted: a conversation's audit, then its turns."""
    state, edits = START, iter("")

    def inserted(letter: str) -> Iterator[tuple[None, str, str]]:
        nonlocal state
        while letter == "I":
            state = _WANTED[state]
            yield None, ROLES[state], ""
            letter = next(edits, "")
        return letter

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", *_COUNTS, "audit", "role", "text")]
        for *head, audit, role, text in zip(*columns, strict=True):
            if audit is not None:
                yield from inserted(next(edits, ""))
                state, edits = START, iter(audit)
                yield (*head, audit), "", ""
                continue
            letter = yield from inserted(next(edits))
            if letter == "K":
                state = _KEPT[state, initial_of(role)]
                yield None, role, text
            elif letter == "R":
                state = _WANTED[state]
                yield None, ROLES[state], text
    yield from inserted(next(edits, ""))


def _with_audits(rows: DataFrame) -> DataFrame:
    """Turns behind their conversation's audit, sorted within partitions that hold whole conversations."""
    empty = [F.lit(None).cast("long").alias(c) for c in _COUNTS]
    turns = rows.where("not gone").select("conv_id", *empty, F.lit(None).cast("string").alias("audit"), "turn", "role", "text", _digest().alias("digest"))
    kind = rows.schema["turn"].dataType
    heads = audits(rows).select("conv_id", *_COUNTS, "audit", F.lit(None).cast(kind).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"))
    both = heads.unionByName(turns).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "digest").select("conv_id", *_COUNTS, "audit", "role", "text")


def repairs(rows: DataFrame) -> DataFrame:
    """A row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, the last of the repaired
    turns as ``role:text`` lines.

    ``rows`` are ``conv_id, turn, role, text`` and ``gone``, as :func:`damage` gives them; other columns are not looked at. Turns are taken by
    number, those without one first; turns of one number (ties) by the SHA-256 of role and text, so that equal ones are neighbours. Roles go
    by their first letter; any but ``s``, ``u`` and ``a``, and an empty role, must be changed or go. A conversation whose turns are all gone,
    or that is repaired by deleting them all, has the hash of the empty text; rows without a conversation's id are one conversation. An empty
    table gives no rows. Long texts are hashed whole, a turn at a time; a hash is sequential, so that one task passes over the turns of one
    conversation and holds a byte a turn.
    """
    schema = T.StructType([rows.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    arrow = _arrow_schema(schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, rest = _flushed(arrow)
        head, sha, joint = None, hashlib.sha256(), b""
        for start, role, text in _walked(batches):
            if start is not None:
                if head:
                    yield from add((*head, sha.hexdigest()), len(head[-1]))
                head, sha, joint = start, hashlib.sha256(), b""
            else:
                sha.update(joint + f"{role}:{text}".encode())
                joint = b"\n"
        if head:
            yield from add((*head, sha.hexdigest()), len(head[-1]))
        yield rest()

    return _with_audits(rows).mapInArrow(hashed, schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text``: the turns of the repaired conversations, numbered from 0. Rows as in :func:`repairs`; conversations of which
    nothing is left have no turns."""
    schema = T.StructType([rows.schema["conv_id"], *(T.StructField(c, t) for c, t in (("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType())))])
    arrow = _arrow_schema(schema)

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, rest = _flushed(arrow)
        conv, turn = None, 0
        for start, role, text in _walked(batches):
            if start is not None:
                conv, turn = start[0], 0
            else:
                yield from add((conv, turn, role, text), len(text))
                turn += 1
        yield rest()

    return _with_audits(rows).mapInArrow(rebuilt, schema)
