"""Standardising markdown descriptions into plain text with ``###`` section headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import to_java
from .text import bind, drop_non_ascii, title_case, to_ascii

# Rewrite rules up to the header casing rule, applied in this order.
RULES_BEFORE_CASING = [
    (r"\\", r""),                                               # escapes
    (r"(?<=\S) *\n +(?=\S)", r" "),                             # wrapped lines
    (r" {2,}", r" "),                                           # repeated blanks
    (r"(\* ){2,}", r"* "),                                      # repeated bullets
    (r"^ ", r""),                                               # leading blank
    (r" $", r""),                                               # trailing blank
    (r"\n{3,}", "\n\n"),                                        # tall gaps
    (r" *([,.!?:;])", r"$1"),                                   # blank before punctuation
    (r"(?<!\d)\, *(?!\d)", r", "),                              # blank after comma
    (r"(?<=\S)___([ \t]*)___(?=\S)", r"$1"),                    # adjacent bold italics
    (r"(?<=\S)__([ \t]*)__(?=\S)", r"$1"),                      # adjacent bolds
    (r"\: *(_+)", r"$1:"),                                      # colon out of emphasis
    (r"^\s*(#+)([^\s#].+?)\s*$", r""),                          # hash tags
    (r"\s*\#{1,6}\s+", "\n### "),                               # any header level
    (r"^(?!\s*\* )\s*_+(.+?)_+(?!,)\:?\s+(.+?)\s*$", "\n### $1\n\n$2\n"),
    (r"^(?!\s*\* )\s*_+(.+?)\:\s+(.+?)_+\s*$", "\n### $1\n\n$2\n"),
    (r"^(?!\s*\* )\s*(.{3,}?)\:(\*\s+)(.+?)\s*$", "\n### $1\n\n$2$3\n"),
    (r"^(?!\s*\* )\s*(.{3,}?)\:\s+(.+?)\s*$", "\n### $1\n\n$2\n"),
    (r"^\s*_{2,}(.+?)_{2,}\:?\s*$", "\n### $1\n\n"),
    (r"^\s*([A-Z][A-Z?!.,;\-\s]{3,})\s*$", "\n### $1\n\n"),
    (r"^(?!\s*\* )(.+?)\s*\n(\s*\* .+?)", "\n### $1\n\n$2"),    # line before bullets
    (r"(\s*\* .+?)\n+(?!\s*\* )(.+?)\s*$", "$1\n\n### $2"),     # line after bullets
    (r"(### )+", r"### "),                                      # repeated markers
    (r"^\s*\#\#\#\s*_{2,}?(.+?)_{2,}?[:.?! \t]*$", r"### $1"),  # emphasis in headers
]
# Headers written in capitals only, which become title case.
CAPITAL_HEADER = r"^(?:### )([A-Z][A-Z\s]{3,})$"
# Rewrite rules after the header casing rule, applied in this order.
RULES_AFTER_CASING = [
    (r"^###\s*$", r""),                                         # empty headers
    (r"^\s*(.{1,5})\s*$", r""),                                 # tiny lines
    (r"^\s*[\-\=\_\+\*\~]{3,}\s*$", r""),                       # separators
    (r"\n+(\t*\* .+?)$", "\n$1"),                               # gaps between bullets
    (r"\n### (.+?)\n", "\n\n### $1\n\n"),                       # gaps around headers
    (r"_+", r""),                                               # leftover emphasis
    (r"\n{3,}", "\n\n"),                                        # tall gaps
]

# What a rule's matches hold; a rule is not run on texts without it.
NEEDED = {
    r"\\": "\\",
    r"(?<=\S) *\n +(?=\S)": "\n ",
    r" {2,}": "  ",
    r"(\* ){2,}": "* * ",
    r"\n{3,}": "\n\n\n",
    r"(?<=\S)___([ \t]*)___(?=\S)": "___",
    r"(?<=\S)__([ \t]*)__(?=\S)": "__",
    r"\: *(_+)": "_",
    r"^\s*(#+)([^\s#].+?)\s*$": "#",
    r"\s*\#{1,6}\s+": "#",
    r"^(?!\s*\* )\s*_+(.+?)_+(?!,)\:?\s+(.+?)\s*$": "_",
    r"^(?!\s*\* )\s*_+(.+?)\:\s+(.+?)_+\s*$": "_",
    r"^(?!\s*\* )\s*(.{3,}?)\:(\*\s+)(.+?)\s*$": ":*",
    r"^(?!\s*\* )\s*(.{3,}?)\:\s+(.+?)\s*$": ":",
    r"^\s*_{2,}(.+?)_{2,}\:?\s*$": "__",
    r"^(?!\s*\* )(.+?)\s*\n(\s*\* .+?)": "* ",
    r"(\s*\* .+?)\n+(?!\s*\* )(.+?)\s*$": "* ",
    r"(### )+": "### ### ",                                     # a single one stays as it is
    r"^\s*\#\#\#\s*_{2,}?(.+?)_{2,}?[:.?! \t]*$": "__",
    r"^###\s*$": "###",
    r"\n+(\t*\* .+?)$": "* ",
    r"\n### (.+?)\n": "\n### ",
    r"_+": "_",
}

# Two private-use characters: they cannot occur once the text is ASCII.
_OPEN, _CLOSE = "\ue000", "\ue001"


def _rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    def apply(text: Column, rule: tuple[str, str]) -> Column:
        def changed(c: Column) -> Column:
            return F.regexp_replace(c, "(?md)" + to_java(rule[0], True), rule[1])

        needed = NEEDED.get(rule[0])
        if needed is None:
            return changed(text)
        return bind(text, lambda c: F.when(c.contains(needed), changed(c)).otherwise(c))

    return reduce(apply, rules, text)


def _case_headers(text: Column) -> Column:
    """Title-case whatever ``CAPITAL_HEADER`` captures, through a marked-up split."""
    marked = F.regexp_replace(
        text, "(?md)" + to_java(CAPITAL_HEADER, True), f"### {_OPEN}$1{_CLOSE}")

    def cased(c: Column) -> Column:
        pieces = F.split(c, f"[{_OPEN}{_CLOSE}]", -1)
        return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, title_case(p)).otherwise(p)), "")

    return bind(marked, lambda c: F.when(c.contains(_OPEN), cased(c)).otherwise(c))


def clean_ascii(text: Column) -> Column:
    """The rewrite rules on text that is already ASCII."""
    return _rewrite(_case_headers(_rewrite(text, RULES_BEFORE_CASING)), RULES_AFTER_CASING)


def clean_description(text: Column) -> Column:
    return clean_ascii(drop_non_ascii(to_ascii(text)))
