"""Bridging Python-style regular expressions to the JVM's."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_GROUP_NAME = re.compile(r"\(\?P<(\w+)>")
_GROUP_REF = re.compile(r"\(\?P=(\w+)\)")


# What the class escapes cover in Python, spelled as members of a JVM character class.
_CLASSES = {"s": r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", "w": r"\p{L}\p{N}_", "d": r"\p{Nd}"}
# The same for texts that hold ASCII only.
_ASCII_CLASSES = {"s": r"\s\x1c-\x1f", "w": r"\w", "d": r"\d"}
WORD = f"[{_CLASSES['w']}]"
_BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def to_java(pattern: str, ascii_text: bool = False) -> str:
    """Rewrite the spellings that mean something else on the JVM, for any text or for ASCII texts."""
    classes = _ASCII_CLASSES if ascii_text else _CLASSES
    pattern = _GROUP_NAME.sub(r"(?<\1>", pattern)
    pattern = _GROUP_REF.sub(r"\\k<\1>", pattern)
    out, in_class, i = [], False, 0
    while i < len(pattern):
        char, escape = pattern[i], pattern[i + 1:i + 2]
        if char == "\\":
            members = classes.get(escape.lower())
            if members and escape.islower():
                out.append(members if in_class else f"[{members}]")
            elif members:
                out.append(f"[^{members}]")
            elif escape == "b" and not in_class:
                out.append(r"\b" if ascii_text else _BOUNDARY)  # Java's own is quicker, and the same among ASCII
            elif escape == "Z":
                out.append(r"\z")
            else:
                out.append(char + escape)
            i += 2
            continue
        if char in "[&" and in_class:  # nesting and intersection exist only on the JVM
            out.append("\\")
        in_class = (in_class or char == "[") and char != "]"
        out.append(char)
        i += 1
    return "".join(out)


def search(text: Column, pattern: str, ascii_text: bool = False) -> Column:
    """Case-insensitive, Unicode-aware search; null text stays null."""
    return text.rlike(("(?id)" if ascii_text else "(?iud)") + to_java(pattern, ascii_text))


def is_ascii(text: Column) -> Column:
    """Whether text holds ASCII only."""
    return F.octet_length(text) == F.length(text)


# Letters a case-insensitive match treats as i or s, though lower case keeps them.
_FOLDED = {"\u0130": "i", "\u0131": "i", "\u017f": "s"}


def fold(text: Column) -> Column:
    """Lower-cased text in which an ASCII term can be looked for case-sensitively."""
    for letter, plain in _FOLDED.items():
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


_SYNTAX = set(r".^$*+?{}[]|()")


def literal_runs(pattern: str) -> list[str] | None:
    """The literal pieces of a pattern, in order; ``None`` if it has repeats, choices or groups.

    A single piece means the pattern is that text and nothing else.
    """
    runs, i, plain = [""], 0, True
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            escaped = pattern[i + 1:i + 2]
            if escaped.isalnum():
                if escaped not in "bBdDsSwW":
                    return None
                runs.append("")
                plain = False
            else:
                runs[-1] += escaped
            i += 2
            continue
        if char == ".":
            runs.append("")
            plain = False
        elif char in _SYNTAX:
            return None
        else:
            runs[-1] += char
        i += 1
    return [runs[0]] if plain else [*runs, ""]


def search_folded(folded: Column, text: Column, pattern: str, ascii_text: bool = False) -> Column:
    """``search`` that works on folded text wherever this finds the same.

    Text that must occur is looked for as a plain substring before any regex runs.
    """
    runs = literal_runs(pattern)
    if not pattern.isascii():
        return search(text, pattern)
    if runs is not None and len(runs) == 1:
        return folded.contains(runs[0].lower())
    bare = re.sub(r"\\.", "", pattern)
    found = folded.rlike("(?d)" + to_java(pattern, ascii_text)) if bare == bare.lower() else search(text, pattern, ascii_text)
    needed = max(runs, key=len).lower() if runs else ""
    return folded.contains(needed) & found if needed else found


def literal(term: str) -> str:
    """Quote a term so the JVM matches it literally."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
