"""Text functions as Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_LETTERS = r"[^\p{L}\p{N}]+"


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` where ``x`` is computed once, although ``f`` names it several times or within a loop over an array."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, in order; none for a null. What lies between them is split off, which costs far less than matching them."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NO_LETTERS), "")


def collapsed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cleaned(text: Column) -> Column:
    """Without embedded ``<msg>`` markup and bracketed placeholders, white space collapsed."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<msg>.*?</msg>", " ")
    return collapsed(F.regexp_replace(plain, r"\[(image|voice|video|sticker|file)\]", " "))


def clipped(text: Column, n: int) -> Column:
    """At most ``n`` characters, and an ellipsis where some are cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def any_of(words: tuple[str, ...]) -> str:
    """A pattern for any of some words as whole words, whatever their case."""
    return r"(?i)(^|[^\p{L}])(" + "|".join(words) + r")([^\p{L}]|$)"


def html_escaped(text: Column) -> Column:
    """The five characters that HTML reserves as entities."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def character_grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters, in order. The text is computed and taken apart once, so that it costs time in proportion to its length."""

    def runs(chars: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*(F.get(chars, i + k) for k in range(n))))
        return F.when((F.size(chars) >= n) & (chars[0] != ""), each).otherwise(F.array().cast("array<string>"))

    return bound(F.split(F.coalesce(text, F.lit("")), ""), runs)
