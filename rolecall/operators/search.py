"""Search strings: words, quoted phrases, AND, OR, NOT and brackets.

``"software engineer" AND (python OR java) NOT intern`` is read as job boards read it: NOT binds first, then
AND, then OR, and terms that stand next to each other must both occur. Operators are written in capitals;
quoted, they are words like any other. A term occurs if any of the text columns contains it, ignoring case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import fold
from .filters import all_of, any_of, any_term, never_null, none_of

TEXTS = ("title", "description")
_TOKEN = re.compile(r'\s*(?:"([^"]*)"|([()])|([^\s()"]+))')
_OPERATORS = {"AND", "OR", "NOT"}


class SearchError(ValueError):
    """A search string that cannot be read, with the place where reading ended."""

    def __init__(self, problem: str, text: str, place: int):
        super().__init__(f"{problem} at character {place + 1} of {text!r}")
        self.place = place


def _tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, value, place) of each token; kinds are ``term``, the operators and brackets."""
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        found = _TOKEN.match(text, at)
        if not found:
            raise SearchError("unbalanced quote", text, at)
        phrase, bracket, word = found.groups()
        place = found.start(found.lastindex)
        if phrase is not None:
            if not phrase.strip():
                raise SearchError("empty phrase", text, place)
            out.append(("term", phrase.strip(), place))
        elif bracket:
            out.append((bracket, bracket, place))
        else:
            out.append((word if word in _OPERATORS else "term", word, place))
        at = found.end()
    return out


def parse(text: str, term: Callable[[str], Column]) -> Column | None:
    """The search string as a condition over what ``term`` makes of each term; ``None`` if it is blank."""
    tokens = _tokens(text)
    at = 0

    def kind() -> str:
        return tokens[at][0] if at < len(tokens) else ""

    def failed(problem: str) -> SearchError:
        return SearchError(problem, text, tokens[at][2] if at < len(tokens) else len(text))

    def either() -> Column:
        nonlocal at
        parts = [both()]
        while kind() == "OR":
            at += 1
            parts.append(both())
        return any_of(*parts)

    def both() -> Column:
        nonlocal at
        parts = [single()]
        while kind() in ("AND", "NOT", "term", "("):
            at += kind() == "AND"
            parts.append(single())
        return all_of(*parts)

    def single() -> Column:
        nonlocal at
        now = kind()
        if now == "NOT":
            at += 1
            return none_of(single())
        if now == "(":
            opened = at
            at += 1
            inner = either()
            if kind() != ")":
                at = opened
                raise failed("bracket without its end")
            at += 1
            return inner
        if now != "term":
            raise failed(f"{now} without a term" if now else "a term is missing")
        at += 1
        return term(tokens[at - 1][1])

    if not tokens:
        return None
    condition = either()
    if at < len(tokens):
        raise failed("bracket without its start" if kind() == ")" else "unexpected token")
    return condition


def with_searches(df: DataFrame, searches: dict[str, str], columns: Sequence[str] = TEXTS) -> DataFrame:
    """``df`` with a boolean column for each search string, never null; a blank string matches every row.

    The texts are folded once for all terms.
    """
    folded = {f"_folded_{i}": fold(F.col(c)) for i, c in enumerate(columns)}

    def occurs(term: str) -> Column:
        if term.isascii():
            found = [F.col(name).contains(term.lower()) for name in folded]
        else:
            found = [any_term(F.col(c), term) for c in columns]
        return any_of(*map(never_null, found))

    conditions = {name: parse(text, occurs) for name, text in searches.items()}
    found = {name: F.lit(True) if c is None else c for name, c in conditions.items()}
    return df.withColumns(folded).withColumns(found).drop(*folded)


def matching(df: DataFrame, search: str, columns: Sequence[str] = TEXTS) -> DataFrame:
    """The rows that a search string matches."""
    return with_searches(df, {"_found": search}, columns).where("_found").drop("_found")


def _part(expression: str, alone: bool) -> str:
    """An expression as a part of a larger one."""
    tokens = _tokens(expression)
    if len(tokens) == 1 and tokens[0][0] == "term":
        value = tokens[0][1]
        plain = re.fullmatch(r'[^\s()"]+', value) and value not in _OPERATORS
        return value if plain else f'"{value}"'
    if all(k == "term" for k, _, _ in tokens) and '"' not in expression and "(" not in expression:
        return f'"{expression.strip()}"'
    return expression if alone else f"({expression})"


def conjunction(expressions: Sequence[str]) -> str:
    """One search string that asks for all expressions; several plain words are a phrase."""
    return " AND ".join(_part(e, len(expressions) == 1) for e in expressions)


def disjunction(expressions: Sequence[str]) -> str:
    """One search string that asks for any of the expressions."""
    return " OR ".join(_part(e, len(expressions) == 1) for e in expressions)


def negation(expression: str) -> str:
    """A search string for what the expression does not match."""
    return f"NOT {_part(expression, False)}"
