"""Filters: typed predicates, a named registry folded into one filter, and boolean search."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import fold, literal, search

Scalar = bool | int | float
Expression = str | Scalar | Iterable | Callable[[Column], Column]

LITERAL, REGEX = "literal", "regex"

# Degree bins each degree level lets through; 0 names no degree.
DEGREE_LEVELS = {
    "none": [],
    "bachelor": [0, 1, 3, 7],
    "master": [0, 2, 3, 6, 7],
    "doctorate": [0, 4, 5, 6, 7],
}


@dataclass(frozen=True)
class FilterSpec:
    column: str
    expression: Expression
    invert: bool = False
    mode: str = LITERAL


@dataclass(frozen=True)
class Mask:
    """A table of keys and flags; rows whose key is flagged match, unknown keys do not."""

    table: DataFrame
    on: str
    flag: str
    invert: bool = False


def never_null(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def any_term(text: Column, terms: str | Iterable[str], mode: str = LITERAL) -> Column:
    """Does the text contain any term, ignoring case? Null for null text.

    Terms are trimmed and blank ones dropped; with none left every text matches.
    """
    cleaned = [t.strip() for t in ([terms] if isinstance(terms, str) else terms)]
    cleaned = [t for t in cleaned if t]
    if not cleaned:
        return text.isNotNull()
    if mode == REGEX:
        return search(text, "|".join(f"(?:{t})" for t in cleaned))
    plain = [fold(text).contains(t.lower()) for t in cleaned if t.isascii()]
    other = [literal(t.lower()) for t in cleaned if not t.isascii()]
    if other:
        plain.append(text.rlike("(?iu)" + "|".join(other)))
    return reduce(Column.__or__, plain)


def _equals(df: DataFrame, name: str, value: Scalar) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return F.col(name) == F.lit(value if not isinstance(value, bool) else int(value))
    if isinstance(kind, T.BooleanType):
        if value not in (0, 1):
            return F.lit(False)
        return F.col(name) == F.lit(bool(value))
    return F.lit(False)


def predicate(df: DataFrame, spec: FilterSpec) -> Column:
    """Condition of one filter; an unknown column or mixed list matches nothing.

    Left nullable where a filter drops null anyway, so that it can reach the scan; an inverted
    filter keeps the rows whose condition is null.
    """
    name, expression = spec.column, spec.expression
    if name not in df.columns:
        matched = F.lit(False)
    elif callable(expression):
        matched = expression(F.col(name))
    elif isinstance(expression, (bool, int, float)):
        matched = _equals(df, name, expression)
    elif isinstance(expression, str):
        matched = any_term(F.col(name), expression, spec.mode)
    else:
        items = list(expression)
        if not items:
            matched = F.lit(False)
        elif all(isinstance(i, (bool, int, float)) for i in items):
            matched = reduce(Column.__or__, [_equals(df, name, i) for i in items])
            if isinstance(df.schema[name].dataType, T.NumericType):
                matched = F.col(name).isin([int(i) if isinstance(i, bool) else i for i in items])
        elif all(isinstance(i, str) for i in items):
            matched = any_term(F.col(name), items, spec.mode)
        else:
            matched = F.lit(False)
    return ~never_null(matched) if spec.invert else matched


def with_filter(registry: Mapping, name: str, spec: FilterSpec | Mask | None) -> dict:
    """Registry with one filter set, replaced, or (``None``) cleared."""
    changed = {k: v for k, v in registry.items() if k != name or spec is not None}
    if spec is not None:
        changed[name] = spec
    return changed


def apply_filters(df: DataFrame, registry: Mapping[str, FilterSpec | Mask]) -> DataFrame:
    """Rows matching every filter; an empty registry keeps all rows."""
    conditions = [predicate(df, s) for s in registry.values() if isinstance(s, FilterSpec)]
    if conditions:
        df = df.where(reduce(Column.__and__, conditions))
    for mask in (s for s in registry.values() if isinstance(s, Mask)):
        flagged = mask.table.where(F.col(mask.flag)).select(mask.on)
        df = df.join(flagged, mask.on, "left_anti" if mask.invert else "left_semi")
    return df


def recent(date: Column, as_of: str, days: int) -> Column:
    """ISO date strings no older than ``days`` before ``as_of``; a literal bound reaches the scan."""
    cutoff = dt.date.fromisoformat(as_of[:10]) - dt.timedelta(days=days)
    return date >= F.lit(cutoff.isoformat())


def active(df: DataFrame, as_of: str, days: int, only_favorites: bool = False) -> DataFrame:
    """The rows a view starts from: recent ones, or all favourites instead."""
    if only_favorites:
        return df.where(F.col("is_favorite"))
    return df.where(recent(F.col("date_posted"), as_of, days))


def newer_than_hours(date: Column, as_of: str, hours: int) -> Column:
    """Dates on or after the day that lies ``hours`` before ``as_of``; null dates are out."""
    cutoff = dt.datetime.fromisoformat(as_of) - dt.timedelta(hours=hours)
    return date.try_cast("date") >= F.lit(cutoff.date())


def degree_filter(level: str) -> FilterSpec | None:
    bins = DEGREE_LEVELS.get(level)
    return FilterSpec("degree_bin", bins) if bins else None


def work_model_filter(models: list[str]) -> FilterSpec | None:
    """Active only when exactly one work model is chosen."""
    if len(models) != 1:
        return None
    return FilterSpec("is_remote", [models[0].upper() == "REMOTE"])


def term_filter(column: str, terms: list[str], invert: bool = False) -> FilterSpec | None:
    return FilterSpec(column, terms, invert) if terms else None


def profile_filters(profile) -> dict[str, FilterSpec]:
    """The filters a profile asks for, by name."""
    wanted = {
        "degree_level": degree_filter(profile.degree_level),
        "work_models": work_model_filter(profile.work_models),
        "job_types": term_filter("job_type", profile.job_types),
        "title_exclude": term_filter("title", profile.title_exclude_selected, invert=True),
        "title_require": term_filter("title", profile.title_require_selected),
        "descr_exclude": term_filter("description", profile.descr_exclude_selected, invert=True),
        "descr_require": term_filter("description", profile.descr_require_selected),
    }
    return {name: spec for name, spec in wanted.items() if spec is not None}


def mentions(term: str, *columns: str) -> Column:
    """The phrase occurs in any of the text columns."""
    return reduce(Column.__or__, [any_term(F.col(c), term) for c in columns])


def all_of(*conditions: Column) -> Column:
    return reduce(Column.__and__, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(Column.__or__, conditions)


def none_of(*conditions: Column) -> Column:
    """No condition holds; one that is null does not."""
    return ~never_null(any_of(*conditions))
