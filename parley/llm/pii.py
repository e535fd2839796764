"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, schemes and identifier cues in one pass; from each anchor a local
parser expands to the boundaries and validates. Digit runs are the anchors of addresses and card numbers. The base kinds
(email, ip, card, phone) are leftmost and non-overlapping per kind. On top come ``account`` spans: what follows an
identifier cue, by the cue's own parser (a bank account's check digits, a social security number's ranges, the shape of a
passport or account number, a secret's letters and digits), bank accounts without a cue, and credentials in URLs; and
``address`` spans: a house number with the street name that a street word ends.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "account", "address")
BASE = KINDS[:4]
#: Cues by the parser of what follows them.
CUES = {
    "secret": ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key"),
    "iban": ("iban",),
    "number": ("account no", "account number", "acct no"),
    "ssn": ("ssn", "social security"),
    "passport": ("passport no", "passport number"),
}
SCHEMES = ("://",)
STREETS = (" street", " avenue", " road", " lane", " drive", " boulevard")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Between a cue and its value: for secrets something that assigns, for the others it may be missing.
_ASSIGNED = re.compile(r"""[\x20\t]{0,3}(?:[:=]|\bis\b)[\x20\t]{0,3}["']?""")
_NAMED = re.compile(r"""(?:\x20(?:no\.?|number))?[\x20\t.]{0,3}(?:[:=#]|\bis\b)?[\x20\t]{0,3}["']?""")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: What may follow a cue, by its parser; each match is validated further.
_VALUES = {
    "secret": re.compile(r"[A-Za-z0-9][A-Za-z0-9_+/.=-]{6,}"),
    "iban": _IBAN,
    "number": re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}(?![0-9])"),
    "ssn": re.compile(r"[0-9]{3}-?[0-9]{2}-?[0-9]{4}(?![0-9])"),
    "passport": re.compile(r"[A-Z0-9]{6,9}(?![A-Za-z0-9])"),
}
_STREET = re.compile(r"(?<![A-Za-z0-9])[0-9]{1,5}[A-Za-z]?(?:\x20[A-Z][a-z'.-]{0,30}){2,5}$")
_DIGITS = re.compile(r"[0-9]+")
_CREDENTIALS = re.compile(r"[^\s/@:]+:[^\s/@]+(?=@)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban(text: str) -> bool:
    """Whether a bank account number has its length and its check digits right."""
    plain = text.replace(" ", "")
    turned = plain[4:] + plain[:4]
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def social_security(text: str) -> bool:
    """Whether area, group and serial are ones that are given out."""
    d = text.replace("-", "")
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


_VALID = {
    "secret": lambda v: any(c.isdigit() for c in v),
    "iban": iban,
    "number": lambda v: True,
    "ssn": social_security,
    "passport": lambda v: any(c.isdigit() for c in v),
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("at", "@"), ("plus", "+"), ("scheme", SCHEMES), ("street", STREETS), *CUES.items()):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def _ascii_lower(text: str) -> str:
    """Lower case of the same length, for finding cues whatever their case."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c < "\x80" else c for c in text)


def _emails(text: str, ats: list[int]) -> list[tuple[int, int]]:
    out, free = [], 0
    for at in ats:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
    return out


def _numbers(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Addresses and card numbers, from the runs of digits that could begin one."""
    ips, cards, ip_free, card_free = [], [], 0, 0
    for run in _DIGITS.finditer(text):
        start, end = run.span()
        follows = text[end : end + 2]
        at = max(start, ip_free)
        if at < end and follows[:1] == "." and (m := _IP.match(text, at)):
            ip_free = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                ips.append(m.span())
        at = max(start, card_free)
        # a match needs a second digit, in the run or after a blank or hyphen
        if at < end and (end - at > 1 or (follows[:1] in (" ", "-") and follows[1:].isdigit() and follows.isascii())):
            m = _CARD.match(text, at)
            card_free = m.end()
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    return ips, cards


def _phones(text: str, pluses: list[int]) -> list[tuple[int, int]]:
    out, free = [], 0
    for at in pluses:
        if at >= free and (m := _PHONE.match(text, at)):
            free = m.end()
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(m.span())
    return out


def _accounts(text: str, cues: list[tuple[int, str]], schemes: list[int]) -> list[tuple[int, int]]:
    out, free = [], 0
    for end, kind in sorted(cues):
        gap = (_ASSIGNED if kind == "secret" else _NAMED).match(text, end)
        if end < free or not gap:
            continue
        if (m := _VALUES[kind].match(text, gap.end())) and (value := _trimmed(m.group(), kind)):
            out.append((m.start(), m.start() + len(value)))
            free = out[-1][1]
    out += [(m.start(), m.start() + len(v)) for m in _LOOSE_IBAN.finditer(text) if (v := _trimmed(m.group(), "iban"))]
    out += [m.span() for end in schemes if (m := _CREDENTIALS.match(text, end))]
    return sorted(set(out))


_LOOSE_IBAN = re.compile(r"(?<![A-Za-z0-9])" + _IBAN.pattern)


def _trimmed(value: str, kind: str) -> str | None:
    """The value if it is valid; a bank account may have taken in following words, which are let go one by one."""
    while kind == "iban" and not iban(value) and " " in value:
        value = value.rpartition(" ")[0]
    return value if _VALID[kind](value) else None


def _addresses(text: str, streets: list[int]) -> list[tuple[int, int]]:
    """House numbers with the capitalised words up to a street word, from that word backwards."""
    out: list[tuple[int, int]] = []
    for end in streets:
        if end < len(text) and text[end].isalnum():
            continue
        lo = max(out[-1][1] if out else 0, end - 150)
        if m := _STREET.search(text, lo, end):
            out.append((m.start(), end))
    return out


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All spans ``(start, end, kind)`` in code points, by start and then kind as listed in KINDS."""
    at: dict[str, list[int]] = {"at": [], "plus": [], "scheme": [], "street": []}
    cues: list[tuple[int, str]] = []
    for last, (kind, length) in anchors.iter(_ascii_lower(text)):
        if kind in CUES:
            if last - length < 0 or not text[last - length].isalnum():  # not within a word
                cues.append((last + 1, kind))
        else:
            at[kind].append(last if kind in ("at", "plus") else last + 1)
    ips, cards = _numbers(text)
    found = zip(KINDS, (_emails(text, at["at"]), ips, cards, _phones(text, at["plus"]), _accounts(text, cues, at["scheme"]), _addresses(text, at["street"])), strict=True)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(((s, e, k) for k, spans in found for s, e in spans), key=lambda x: (x[0], order[x[2]], x[1]))


_OUT = "doc_id long, spans array<struct<start:long,end:long,kind:string>>"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    for batch in batches:
        spans = [[{"start": s, "end": e, "kind": k} for s, e, k in find_spans(t, anchors)] if t else [] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, spans`` (start, end, kind; code points, end exclusive).

    A null text is empty and has no spans. Ids may be null; repeated rows are searched each; very long texts are searched whole; other
    columns are not read. A table without rows gives none.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_batches, _OUT)


def digest(spans: list[tuple[int, int, str]]) -> tuple[Counter, str]:
    """Counts per kind, and the SHA-256 of the base spans as text; for tests."""
    base = ",".join(f"{k}:{s}:{e}" for s, e, k in spans if k in BASE)
    return Counter(k for _, _, k in spans), hashlib.sha256(base.encode()).hexdigest()
