"""Personal data of eight guarded classes in chat texts, and their redaction in one pass.

All classes are looked for at once; of matches that overlap the one that begins first stays, the longer one where two begin
together, so that no character is replaced twice. A value has the same placeholder everywhere. Names of works that hold a
street's word are protected. Texts go through Arrow in batches; a text costs time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.llm.support import text_slices

# Patterns of the classes, in the order in which they are looked for. They hold no word boundaries, which never lie between a digit and a Chinese character.
PATTERNS = {
    "api_key": r"(?i)(?<![0-9A-Za-z])(?:sk|api[_-]?key|token|secret)[-_:=\s]*[A-Za-z0-9_\-]{16,}(?![0-9A-Za-z_\-])",
    "id_card": r"(?<![0-9A-Za-z])\d{17}[\dXx](?![0-9A-Za-z])",
    "bank_card": r"(?<![0-9A-Za-z])(?:\d[ -]?){16,19}(?![0-9A-Za-z])",
    "phone": r"(?<!\d)(?:\+?86[-\s]?)?1[3-9]\d{9}(?!\d)",
    "email": r"(?<![0-9A-Za-z])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![0-9A-Za-z])",
    "url": r"""(?i)(?<![0-9A-Za-z])(?:https?://|www\.)[^\s<>()"'，。；、！？）】」』]*""",
    "landline": r"(?<!\d)(?:0\d{2,3}[-\s]?\d{7,8}|400[-\s]?\d{3,4}[-\s]?\d{3,4})(?!\d)",
    "address": r"[一-龥]{2,}(?:省|市|区|县|镇|乡|路|街|巷|号楼|单元|室)[一-龥A-Za-z0-9\-]{2,30}",
}
KINDS = tuple(PATTERNS)
# Where an address ends its first part, what follows it, words of streets, and words near by that tell a home.
_PLACE, _TAIL = ("号楼", "单元", "省", "市", "区", "县", "镇", "乡", "路", "街", "巷", "室"), r"[一-龥A-Za-z0-9\-]{2,30}"
STREETS = ("路", "街", "巷", "道")
HOMES = ("住在", "家在", "位于", "地址", "址在", "搬到", "迁至", "小区", "号楼", "单元", "宿舍", "公寓", "门店", "校区")
# Names of works and of persons in them that look like addresses.
PROTECTED = ("路易吉", "马里奥", "塞尔达", "皮卡丘", "宝可梦", "海拉鲁", "原神", "星穹铁道", "艾尔登", "法环", "黑神话", "悟空传", "霍格沃茨", "哈利波特", "中土世界", "赛博朋克")


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    kind: str
    value: str

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.value.encode(errors="surrogatepass")).hexdigest()

    @property
    def placeholder(self) -> str:
        return f"[{self.kind.upper()}_{self.digest[:6].upper()}]"


_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items() if k != "address"}
_HAN_RUN, _PLACES, _FOLLOWING = re.compile(r"[一-龥]{3,}"), re.compile(f"(?={'|'.join(f'({p})' for p in _PLACE)})"), re.compile(_TAIL)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, which would try every length at every place: here each run of Chinese characters is read
    once, from its end."""
    done = 0
    for run in _HAN_RUN.finditer(text):
        places = [(m.start(), m.start() + len(next(filter(None, m.groups())))) for m in _PLACES.finditer(text, run.start(), run.end() + 1)]
        at = max(run.start(), done)
        while at < run.end():
            best = next(((e, tail.end()) for s, e in reversed(places) if s >= at + 2 and s < run.end() and (tail := _FOLLOWING.match(text, e))), None)
            if best is None:
                break
            yield at, best[1]
            at = done = best[1]


def _only_a_street(text: str, start: int, end: int) -> bool:
    """Whether an address is a street's name only: no number follows, and nothing near by tells that somebody lives there."""
    street = next((i for i in range(start + 2, end) if text[i] in STREETS), None)
    if street is None or any(c.isdigit() for c in text[street + 1 : end]):
        return False
    near = text[max(0, start - 6) : street]
    return not any(w in near for w in HOMES)


def shielded(text: str, protected: tuple[str, ...] = PROTECTED) -> str:
    """The text with protected names as private characters, each character in its place."""
    for i, name in enumerate(protected):
        if name in text:
            text = text.replace(name, chr(0xF0000 + i) * len(name))
    return text


def matches(text: str) -> list[Found]:
    """All matches of all classes, those of a class without overlap among themselves."""
    found = [Found(m.start(), m.end(), kind, m.group()) for kind, pattern in _COMPILED.items() for m in pattern.finditer(text)]
    return found + [Found(a, b, "address", text[a:b]) for a, b in _addresses(text) if not _only_a_street(text, a, b)]


def resolved(found: list[Found]) -> list[Found]:
    """Of overlapping matches the first to begin, then the longest, then the first class."""
    kept: list[Found] = []
    for f in sorted(found, key=lambda f: (f.start, -f.end)):
        if not kept or f.start >= kept[-1].end:
            kept.append(f)
    return kept


def redact(text: str, protected: tuple[str, ...] = PROTECTED) -> tuple[str, list[Found]]:
    """The text with placeholders, and what they stand for."""
    out, at, kept = [], 0, resolved(matches(shielded(text, protected)))
    for f in kept:
        out += [text[at : f.start], f.placeholder]
        at = f.end
    return "".join([*out, text[at:]]), kept


_SPANS = "array<struct<start:int,end:int,kind:string,placeholder:string,digest:string>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("placeholder", pa.string()), ("digest", pa.string())])


def _in_slices(texts: pa.Array, run: Callable[[list[str | None]], pa.Array], empty: pa.DataType) -> pa.Array:
    """``run`` over a batch's texts, of which only slices of 2 MB are Python's strings at once; what they took goes back to the system."""
    parts = [run(texts.slice(rows.start, rows.stop - rows.start).to_pylist()) for rows in text_slices(texts)]
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(parts) if parts else pa.array([], empty)


def redacted(text: Column, protected: tuple[str, ...] = PROTECTED) -> Column:
    """``redacted, spans``: the text with placeholders ``[KIND_HASH]``, and where (in characters) and what they replace, by hash. Null for a null."""
    kind = pa.struct([("redacted", pa.string()), ("spans", pa.list_(_SPAN))])

    def done(texts: list[str | None]) -> pa.Array:
        found = [(None, None) if t is None else redact(t, protected) for t in texts]
        spans = [None if own is None else [(f.start, f.end, f.kind, f.placeholder, f.digest) for f in own] for _, own in found]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array(spans, pa.list_(_SPAN))], fields=list(kind))

    def run(texts: pa.Array) -> pa.Array:
        return _in_slices(texts, done, kind)

    return F.arrow_udf(run, f"redacted string, spans {_SPANS}")(text)


def entities(text: Column) -> Column:
    """The kinds of personal data in a text, as a sorted set; without protection of names, so that rather more are found. Empty for a null."""
    kind = pa.list_(pa.string())

    def run(texts: pa.Array) -> pa.Array:
        return _in_slices(texts, lambda own: pa.array([sorted({f.kind for f in matches(t or "")}) for t in own], kind), kind)

    return F.arrow_udf(run, "array<string>")(text)
