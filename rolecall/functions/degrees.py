"""Degree mentions in free text."""

from __future__ import annotations

from pyspark.sql import Column

from .arrow_text import fold_slashless, mentions

# Spellings of each degree level.
BACHELOR = [
    r"b\.?a\.?", r"b\.?s\.?", r"b\.?sc\.?", r"b\.?s\.?e\.?", r"b\.?eng\.?", r"b\.?b\.?a\.?",
    "bfa", "bit", r"bachelor\'?s?", "undergrad(?:uate)?", r"four-year\s+degree",
    r"4-year\s+degree", r"university\s+degree", r"degree\s+in\s+\w+",
]
MASTER = [
    r"m\.?a\.?", r"m\.?s\.?", r"m\.?b\.?a\.?", r"m\.?sc\.?", r"m\.?s\.?e\.?", r"m\.?eng\.?",
    "mph", "mcs", "mfa", r"master\'?s?", r"graduate\s+degree", r"advanced\s+degree",
    "post-?graduate",
]
DOCTORATE = [r"ph\.?d\.?", "doctor(?:ate|al)", "jd", "md", "edd", "dphil"]


def slashless(text: Column) -> Column:
    """Folded text in which a slash separates words, ready for the level tests."""
    return fold_slashless(text)


def _mentions(folded: Column, spellings: list[str]) -> Column:
    # Whole words only. A spelling's closing dot may be left out, so no word may follow.
    return mentions(folded, spellings)


def has_bachelor(folded: Column) -> Column:
    return _mentions(folded, BACHELOR)


def has_master(folded: Column) -> Column:
    return _mentions(folded, MASTER)


def has_doctorate(folded: Column) -> Column:
    return _mentions(folded, DOCTORATE)


def degree_bin(ba: Column, ma: Column, phd: Column) -> Column:
    """Bit mask: 1 bachelor, 2 master, 4 doctorate."""
    return (ba.cast("int") + ma.cast("int") * 2 + phd.cast("int") * 4).cast("int")
