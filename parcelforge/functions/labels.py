"""Labels in front of values, found in the accent-free text and cut from the original by place.

Folding keeps a letter a letter, so a place in the folded text is the same place
in the text. Phrases are accent-free words with one space between them; between
their words any white space may stand, or none.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelforge.functions.text import fold_accents, let

_SIGNS = r"[\s:.\-]*"


def any_of(phrases: Sequence[str]) -> str:
    """A pattern for the phrases, longer ones first, that stand as words of their own."""
    spaced = (r"\s*".join(map(re.escape, p.split())) for p in sorted(phrases, key=lambda p: (-len(p), p)))
    return rf"(?<![\p{{L}}\d])(?:{'|'.join(spaced)})(?![\p{{L}}])"


def after_label(text: Column, phrases: Sequence[str], anywhere: bool = False, folded: bool = True) -> Column:
    """The text behind the label that it begins with, or behind its first label; without one the text. ``folded`` is false for phrases that are to match with their accents."""
    pattern = rf"(?s)^({'.*?' if anywhere else ''}{any_of(phrases)}{_SIGNS})"

    def cut(t: Column) -> Column:
        head = F.regexp_extract(fold_accents(t) if folded else F.lower(t), pattern, 1)
        return F.substring(t, F.length(head) + 1, F.length(t))

    return let(text, cut)


def before_label(text: Column, phrases: Sequence[str]) -> Column:
    """The text up to its first label, without the signs before that."""
    # a text without a label gives its whole length, as the pattern then ends it
    pattern = rf"(?s)^(.*?)(?:[\s,;]*{any_of(phrases)}.*|$)"
    return let(text, lambda t: F.substring(t, F.lit(1), F.length(F.regexp_extract(fold_accents(t), pattern, 1))))


def holds(text: Column, phrases: Sequence[str]) -> Column:
    """Whether the accent-free text holds one of the phrases as words."""
    return fold_accents(text).rlike(any_of(phrases))
