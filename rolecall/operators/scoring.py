"""Derived columns and the four ranking scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow_text import found_places, scannable
from ..functions.degrees import (
    degree_bin, has_bachelor, has_doctorate, has_master, slashless)
from ..functions.location import parse_location
from ..functions.patterns import fold, search_folded
from ..schema import DERIVED
from .filters import never_null

# Presets of the (bachelor, master, doctorate) weights.
DEGREE_PRESETS = {
    "none": (0, 0, 0), "bachelors": (5, -3, -3), "masters": (0, 5, -3), "doctorate": (0, 0, 5),
}


def derive(df: DataFrame) -> DataFrame:
    """Add city, state, the degree flags and the degree bit mask, where they are not stored."""
    if set(DERIVED.fieldNames()) <= set(df.columns):
        return df
    text = slashless(F.col("description"))  # in the same pass as the level tests
    flagged = df.withColumns({
        "has_ba": has_bachelor(text), "has_ma": has_master(text), "has_phd": has_doctorate(text),
        "_place": parse_location(F.col("location"))})
    return flagged.withColumns({
        "city": F.col("_place.city"), "state": F.col("_place.state"),
        "degree_bin": degree_bin(F.col("has_ba"), F.col("has_ma"), F.col("has_phd")),
    }).drop("_place")


def rank_scores(order: Sequence[str], case_insensitive: bool = False) -> dict[str, int]:
    """The score of each value that has one."""
    scores = {v: len(order) - i for i, v in enumerate(order)}
    if case_insensitive:
        scores = {v.lower(): s for v, s in reversed(scores.items())}
    return {**scores, "": -1}


def rank_order_score(
    value: Column, order: Sequence[str], case_insensitive: bool = False
) -> Column:
    """n for the first listed value down to 1 for the last; empty -1, unlisted or null 0."""
    scores = rank_scores(order, case_insensitive)
    value = F.lower(value) if case_insensitive else value
    lookup = F.create_map(*chain.from_iterable((F.lit(v), F.lit(s)) for v, s in scores.items()))
    return F.coalesce(lookup[value], F.lit(0)).cast("int")


def degree_score(weights: Sequence[int]) -> Column:
    flags = (F.col(c).cast("int") for c in ("has_ba", "has_ma", "has_phd"))
    ba, ma, phd = (flag * w for flag, w in zip(flags, weights))
    return (ba + ma + phd).cast("int")


def with_hits(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Add ``_hits``: the places of the terms found in title or description."""
    texts = (F.col("title"), F.col("description"))
    searches = [scannable(term) for term in terms]
    scanned = [(i, s) for i, s in enumerate(searches) if s is not None]
    folded = df.withColumns({"_title": fold(texts[0]), "_text": fold(texts[1])})
    hits = [
        F.when(
            never_null(search_folded(F.col("_title"), texts[0], term))
            | never_null(search_folded(F.col("_text"), texts[1], term)), F.lit(i))
        for i, term in enumerate(terms) if searches[i] is None
    ]
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")
    if scanned:
        places = found_places(texts, scanned)
        found = F.array_sort(F.concat(places, found)) if hits else places
    return folded.withColumn("_hits", found).drop("_title", "_text")


def with_keywords(df: DataFrame, scored_terms: Mapping[int, Sequence[str]]) -> DataFrame:
    """Add ``keyword_score`` and ``keywords``.

    A term found in title or description counts its weight once; terms are regular
    expressions. Matched terms keep the order given, weight 0 included.
    """
    terms = [(term, weight) for weight, listed in scored_terms.items() for term in listed]
    if not terms:
        return df.withColumns({
            "keyword_score": F.lit(0), "keywords": F.array().cast("array<string>")})
    columns = df.columns
    found = with_hits(df, [term for term, _ in terms])
    names = F.array(*[F.lit(term.replace("\\", "")) for term, _ in terms])
    weights = F.array(*[F.lit(weight) for _, weight in terms])
    return found.select(
        *columns,
        F.aggregate("_hits", F.lit(0), lambda acc, i: acc + F.get(weights, i)).alias("keyword_score"),
        F.transform("_hits", lambda i: F.get(names, i)).alias("keywords"))


def score(df: DataFrame, profile) -> DataFrame:
    """All four scores of one profile on derived rows."""
    scored = df.withColumns({
        "site_score": rank_order_score(F.col("site"), profile.sites_selected),
        "location_score": rank_order_score(F.col("state"), profile.location_order_selected),
        "degree_score": degree_score(profile.degree_values),
    })
    return with_keywords(scored, profile.scored_terms)
