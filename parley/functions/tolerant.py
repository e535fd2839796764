"""JSON objects in noisy text: found, mended and read, as a Spark column.

Around the object may stand talk, a code fence, or reasoning that echoes a template; the last object that reads counts,
of those after the end of the reasoning if any do. Within, quotes inside of strings, commas before a closing bracket and
ends that are cut off are mended. A pass over the text keeps a stack of open brackets; a text costs time in proportion to its length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE, _ENDS = " \t\r\n", ",}]:"
_CLOSES = {"{": "}", "[": "]"}
#: What ends a model's reasoning before its answer.
REASONED = "</think>"


def _strings_mended(text: str) -> Iterator[tuple[str, bool]]:
    """Characters with whether they lie in a string (its quotes included). A quote within a string closes it only where a comma, colon, closing bracket or the text's end
    comes next; else it is taken for a character. Raw line ends within strings are escaped."""
    after = [""] * (len(text) + 1)  # the next character that is no white space
    for i in range(len(text) - 1, -1, -1):
        after[i] = text[i] if text[i] not in _SPACE else after[i + 1]
    inside = escaped = False
    depth = 0
    for i, c in enumerate(text):
        if escaped:
            escaped = False
            yield c, True
        elif inside:
            if c == "\\":
                escaped = True
                yield c, True
            elif c == '"':
                if not after[i + 1] or after[i + 1] in _ENDS:
                    inside = False
                    yield c, True
                else:
                    yield '\\"', True
            else:
                yield {"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, c), True
        else:
            depth += (c in _CLOSES) - (c in "}]" and depth > 0)
            inside = c == '"' and depth > 0
            yield c, inside


def _objects(text: str) -> Iterator[list[str]]:
    """Outermost objects in their order, mended, as readings of which the first that reads counts; one that is cut off at the text's end is closed."""
    parts: list[str] = []
    open_: list[str] = []
    string = False
    for piece, in_string in _strings_mended(text):
        if not open_ and piece != "{":
            continue
        if in_string:
            parts.append(piece)
            string = not (piece == '"' and string)
            continue
        if piece in _CLOSES:
            open_.append(_CLOSES[piece])
        elif piece in "}]":
            while parts and parts[-1] in f",{_SPACE}":
                parts.pop()
            if open_[-1] != piece:  # an inner bracket was left open
                if piece not in open_:
                    continue
                while open_[-1] != piece:
                    parts.append(open_.pop())
            open_.pop()
        parts.append(piece)
        if not open_:
            yield ["".join(parts)]
            parts, string = [], False
    if open_:
        yield _closed("".join(parts), open_, string)


def _closed(text: str, open_: list[str], in_string: bool) -> list[str]:
    """A cut-off object with its string and brackets closed; without its last, half-told member where that doesn't read."""
    ends = "".join(reversed(open_))
    whole = text + ('"' if in_string else "")
    return [body.rstrip(_SPACE + ",") + ends for body in (whole, whole.rstrip(_SPACE + ":") + ": null", whole[: _last_comma(whole)])]


def _last_comma(text: str) -> int:
    """Where the last comma outside of strings stands, or after the last bracket that opens."""
    found, inside, escaped = len(text), False, False
    for i, c in enumerate(text):
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = inside
        elif c == '"':
            inside = not inside
        elif not inside and c in ",{[":
            found = i + (c != ",")
    return found


def _read(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def find_object(text: str | None) -> dict | None:
    """The last object of a text that can be read, of those after the reasoning if there are any; none if nothing can be read."""
    if not text or "{" not in text:
        return None
    head, mark, tail = text.rpartition(REASONED)
    for part in ([tail, head] if mark else [text]):
        found = None
        for candidates in _objects(part):
            found = next((o for c in candidates if (o := _read(c)) is not None), found)
        if found is not None:
            return found
    return None


def tolerant_json(text: Column) -> Column:
    """The object as JSON text (see :func:`find_object`), for ``from_json`` or ``get_json_object``; null where there is none."""

    def run(texts: pd.Series) -> pd.Series:
        found = (find_object(t) for t in texts)
        return pd.Series([None if o is None else json.dumps(o, ensure_ascii=False) for o in found], dtype=object)

    return F.pandas_udf(run, "string")(text)
