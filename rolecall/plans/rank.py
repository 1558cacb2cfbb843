"""Read path: archive rows -> the ranked view of a profile."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import active, apply_filters, profile_filters
from ..operators.scoring import derive, rank_scores, score, with_hits
from ..operators.sorting import standard_order
from ..sources.profiles import Profile


def scored_view(postings: DataFrame, profile: Profile, as_of: str) -> DataFrame:
    """Recent (or favourite) rows with derived columns and scores that pass every filter.

    One lazy plan: filters on stored columns reach the scan, those on derived ones do not.
    """
    rows = active(postings, as_of, profile.max_age_days, profile.display_favorites)
    return apply_filters(score(derive(rows), profile), profile_filters(profile))


def rank(
    postings: DataFrame, profile: Profile, as_of: str, lead: str | None = None,
    ascending: bool = True,
) -> DataFrame:
    return scored_view(postings, profile, as_of).orderBy(*standard_order(lead, ascending))


# One profile as the scores need it; a term is named by its place among all profiles' terms.
_PROFILES = ("array<struct<profile:string, sites:map<string,int>, states:map<string,int>, "
             "degrees:array<int>, terms:array<struct<place:int, name:string, weight:int>>>>")


def score_profiles(derived: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    """Scores of many profiles in one pass: one row per posting and profile.

    Each distinct term is looked for once however many profiles list it, and the profiles are one
    literal, so the plan does not grow with their number.
    """
    listed = {name: [(t, w) for w, terms in p.scored_terms.items() for t in terms]
              for name, p in profiles.items()}
    place = {t: i for i, t in enumerate(dict.fromkeys(t for ts in listed.values() for t, _ in ts))}
    rows = [{
        "profile": name, "sites": rank_scores(p.sites_selected),
        "states": rank_scores(p.location_order_selected), "degrees": list(p.degree_values),
        "terms": [{"place": place[t], "name": t.replace("\\", ""), "weight": w} for t, w in listed[name]],
    } for name, p in profiles.items()]
    columns = derived.columns
    each = with_hits(derived, list(place)).select(
        *columns, "_hits", F.explode(F.from_json(F.lit(json.dumps(rows)), _PROFILES)).alias("_p"))
    found = each.withColumn(
        "_terms", F.filter("_p.terms", lambda t: F.array_contains("_hits", t["place"])))
    flags = [F.col(c).cast("int") * F.get("_p.degrees", i)
             for i, c in enumerate(("has_ba", "has_ma", "has_phd"))]
    return found.select(
        *columns, "_p.profile",
        F.coalesce(F.col("_p.sites")[F.col("site")], F.lit(0)).alias("site_score"),
        F.coalesce(F.col("_p.states")[F.col("state")], F.lit(0)).alias("location_score"),
        (flags[0] + flags[1] + flags[2]).alias("degree_score"),
        F.aggregate("_terms", F.lit(0), lambda a, t: a + t["weight"]).alias("keyword_score"),
        F.col("_terms.name").alias("keywords"))
