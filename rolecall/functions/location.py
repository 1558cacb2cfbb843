"""Location strings to city and state columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, strip, title_case

# State names and their abbreviations, and spellings of the country.
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar",
    "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
    "district of columbia": "dc", "florida": "fl", "georgia": "ga", "hawaii": "hi",
    "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks",
    "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
    "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms",
    "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv",
    "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny",
    "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc",
    "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut",
    "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv",
    "wisconsin": "wi", "wyoming": "wy",
}
COUNTRY = ["us", "usa", "united states", "united states of america"]


def _state_code(part: Column) -> Column:
    """Upper-case code for a state name or code, null for anything else."""
    codes = {**STATES, **{code: code for code in STATES.values()}}
    pairs = chain.from_iterable((F.lit(k), F.lit(v.upper())) for k, v in codes.items())
    return F.create_map(*pairs)[part]


def _looked_up(parts: Column) -> Column:
    first, second, third = (F.get(parts, F.lit(i)) for i in range(3))
    return F.struct(
        F.size(parts).alias("n"), first.alias("first"), second.alias("second"),
        _state_code(F.lower(first)).alias("first_code"),
        _state_code(F.lower(second)).alias("second_code"),
        F.lower(first).isin(COUNTRY).alias("first_is_country"),
        F.lower(second).isin(COUNTRY).alias("second_is_country"))


def _place(p: Column) -> Column:
    n, first_code, second_code = p["n"], p["first_code"], p["second_code"]
    of_country = (n == 2) & p["second_is_country"]
    has_city = (
        ((n == 1) & first_code.isNull() & ~p["first_is_country"])
        | (of_country & first_code.isNull())
        | ((n == 2) & ~of_country & second_code.isNotNull())
        | (n == 3))
    state = (
        F.when((n == 1) | of_country, first_code)
        .when(n == 2, second_code)
        .when(n == 3, F.coalesce(second_code, F.upper(p["second"]))))
    return F.struct(
        F.coalesce(title_case(F.when(has_city, p["first"])), F.lit("")).alias("city"),
        F.coalesce(state, F.lit("")).alias("state"))


def parse_location(location: Column) -> Column:
    """``struct<city, state>``; both empty when the text names neither."""
    parts = F.transform(F.split(F.coalesce(location, F.lit(",,,")), ",", -1), strip)
    return bind(parts, lambda p: bind(_looked_up(p), _place))
