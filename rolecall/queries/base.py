"""Registry of named queries over the test tables, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.degrees import BACHELOR, DOCTORATE, MASTER
from ..functions.location import COUNTRY, STATES
from ..plans.fixture import oracle_postings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run
    return register


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def titled(text: str) -> str:
    """DuckDB expression for title case."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({text}), "
        f"'[{cased}]+|[^{cased}]+'), lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || w[2:]), '')")


def _mentions(spellings: list[str]) -> str:
    word = r"\p{L}\p{N}_"
    alternatives = "|".join(spellings).replace(r"\w", f"[{word}]")
    pattern = f"(?i)(?:^|[^{word}])(?:{alternatives})(?:[^{word}]|$)"
    return f"coalesce(regexp_matches(replace(description, '/', ' '), {quoted(pattern)}), false)"


_STATE_ROWS = ", ".join(
    f"('{key}', '{code.upper()}')"
    for name, code in STATES.items() for key in (name, code))
_COUNTRY = ", ".join(quoted(c) for c in COUNTRY)

_PLACES = f"""
states(key, code) AS (VALUES {_STATE_ROWS}),
cut AS (SELECT ord, list_transform(string_split(location, ','), lambda x: trim(x)) AS p
        FROM postings),
named AS (
  SELECT ord, coalesce(len(p), 0) AS n, p[1] AS a, p[2] AS b, s1.code AS s1, s2.code AS s2,
         lower(p[1]) IN ({_COUNTRY}) AS c1, lower(p[2]) IN ({_COUNTRY}) AS c2
  FROM cut LEFT JOIN states s1 ON lower(p[1]) = s1.key LEFT JOIN states s2 ON lower(p[2]) = s2.key),
places AS (
  SELECT ord,
    CASE WHEN n = 1 AND s1 IS NULL AND NOT c1 THEN {titled('a')}
         WHEN n = 2 AND c2 AND s1 IS NULL THEN {titled('a')}
         WHEN n = 2 AND NOT c2 AND s2 IS NOT NULL THEN {titled('a')}
         WHEN n = 3 THEN {titled('a')} ELSE '' END AS city,
    CASE WHEN n = 1 THEN coalesce(s1, '')
         WHEN n = 2 AND c2 THEN coalesce(s1, '')
         WHEN n = 2 THEN coalesce(s2, '')
         WHEN n = 3 THEN coalesce(s2, upper(b)) ELSE '' END AS state
  FROM named)"""

_DERIVED = f"""
flagged AS (
  SELECT p.*, city, state, {_mentions(BACHELOR)} AS has_ba, {_mentions(MASTER)} AS has_ma,
         {_mentions(DOCTORATE)} AS has_phd
  FROM postings p JOIN places USING (ord)),
derived AS (
  SELECT *, CAST(has_ba AS INT) + CAST(has_ma AS INT) * 2 + CAST(has_phd AS INT) * 4
    AS degree_bin
  FROM flagged)"""


def over_postings(body: str) -> str:
    return f"WITH postings AS ({oracle_postings()}) {body}"


def over_derived(body: str) -> str:
    return f"WITH postings AS ({oracle_postings()}), {_PLACES}, {_DERIVED} {body}"


def over_postings_and(ctes: str, body: str) -> str:
    return f"WITH postings AS ({oracle_postings()}), {ctes} {body}"


def over_derived_and(ctes: str, body: str) -> str:
    return f"WITH postings AS ({oracle_postings()}), {_PLACES}, {_DERIVED}, {ctes} {body}"
