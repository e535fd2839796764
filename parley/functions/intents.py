"""What a live message does, as Spark columns: declines, loses patience, moves the talk on, or only acknowledges."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.lexicon import LIVE, Cues

_PUNCTUATION, _MORE_PUNCTUATION = ("，", ",", "。", "！", "!", "；", ";"), ("：", ":")


def _plain(content: Column) -> Column:
    return F.trim(F.coalesce(content, F.lit("")))


def _compact(content: Column) -> Column:
    return F.replace(_plain(content), F.lit(" "), F.lit(""))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(map(re.escape, words))) if words else F.lit(False)


def interaction_intent(content: Column, cues: Cues = LIVE) -> Column:
    """``decline``, ``impatience`` or null."""
    text = _compact(content)
    ends = "|".join(map(re.escape, cues.decline_at_an_end))
    declines = _any(text, cues.decline_within) | (text.rlike(f"^(?:{ends})|(?:{ends})$") if ends else F.lit(False))
    if cues.decline_around:
        declines |= F.contains(text, F.lit(cues.decline_around[0])) & F.endswith(text, F.lit(cues.decline_around[1]))
    if cues.decline_unless:
        word, others = cues.decline_unless
        declines |= F.contains(text, F.lit(word)) & ~_any(text, others)
    heard = (text != "") & ~text.isin(*cues.nonverbal)
    return F.when(heard & declines, "decline").when(heard & _any(text, cues.impatience), "impatience")


def substantive(content: Column, cues: Cues = LIVE, least_chars: int = 10, least_clause: int = 6, least_detail: int = 4) -> Column:
    """Whether a message asks, plans, tells details or is long enough to move the talk on."""
    text, compact = _plain(content), _compact(content)
    letters = F.regexp_count(text, F.lit("[A-Za-z]")) >= 2
    told = _any(text, (*cues.questions, *cues.plans, *cues.details)) | ((text.rlike(r"\p{Nd}") | letters) & (F.length(compact) >= least_detail))
    long_ = (F.length(compact) >= least_chars) | ((F.length(compact) >= least_clause) & _any(text, _PUNCTUATION))
    return (text != "") & ~compact.isin(*cues.nonverbal) & (told | long_)


def acknowledges(content: Column, cues: Cues = LIVE, most_chars: int = 4) -> Column:
    """Whether a message is a short word of consent and nothing else."""
    text, compact = _plain(content), _compact(content)
    tells = _any(text, (*cues.questions, *cues.plans, *cues.details, *_PUNCTUATION, *_MORE_PUNCTUATION)) | text.rlike(r"\p{Nd}") | (F.length(compact) >= 6)
    return (F.length(text) <= most_chars) & ~tells & F.lower(compact).isin(*cues.acknowledgements)


def acknowledges_strongly(content: Column, cues: Cues = LIVE) -> Column:
    return F.lower(_compact(content)).isin(*cues.strong_acknowledgements)
