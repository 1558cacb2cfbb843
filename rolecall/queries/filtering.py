"""Filter and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.filters import (
    FilterSpec, Mask, active, all_of, any_of, apply_filters,
    degree_filter, mentions, newer_than_hours, none_of, recent, term_filter, work_model_filter)
from ..operators.favorites import with_favorites
from ..operators.scoring import derive
from ..operators.search import with_searches
from ..plans.fixture import AS_OF, postings, table
from .base import over_derived, over_postings, query

_SHOWN = "ord, id, site, title, company, date_posted"


def _filter_query(name, condition, registry, derived=False, shown=_SHOWN):
    wrap, source = (over_derived, "derived") if derived else (over_postings, "postings")

    @query(name, wrap(f"SELECT {shown} FROM {source} WHERE {condition}"))
    def run(spark, sf):
        rows = postings(spark, sf)
        return apply_filters(derive(rows) if derived else rows, registry).selectExpr(
            *shown.split(", "))


_filter_query(
    "terms_any",
    r"coalesce(regexp_matches(title, '(?i)c\+\+|\(intern\)|nurse'), false)",
    {"t": FilterSpec("title", [" C++ ", "", "(intern)", "NURSE"])})
_filter_query("scalar_eq", "coalesce(is_remote, false)", {"r": FilterSpec("is_remote", True)})
_filter_query(
    "scalar_isin", "coalesce(degree_bin IN (1, 3, 4), false)",
    {"b": FilterSpec("degree_bin", (1, 3, 4))}, derived=True, shown=_SHOWN + ", degree_bin")
_filter_query(
    "callable_filter", "coalesce(length(title) > 15 AND title LIKE 'S%', false)",
    {"f": FilterSpec("title", lambda c: (F.length(c) > 15) & c.startswith("S"))})
_filter_query(
    "missing_column", "is_remote",
    {"gone": FilterSpec("no_such_column", "x", invert=True), "r": FilterSpec("is_remote", True)})
_filter_query(
    "title_exclude", "NOT coalesce(regexp_matches(title, '(?i)senior|nurse'), false)",
    {"title_exclude": term_filter("title", ["senior", "nurse"], invert=True)})
_filter_query(
    "title_require", "coalesce(regexp_matches(title, '(?i)data|scientist'), false)",
    {"title_require": term_filter("title", ["data", "Scientist"])})
_filter_query(
    "descr_exclude", "NOT coalesce(contains(lower(description), 'degree'), false)",
    {"descr_exclude": term_filter("description", ["degree"], invert=True)})
_filter_query(
    "descr_require", r"coalesce(regexp_matches(description, '(?i)ph\.d\.|doctoral'), false)",
    {"descr_require": term_filter("description", ["Ph.D.", "doctoral"])})
_filter_query(
    "job_type", "coalesce(regexp_matches(job_type, '(?i)contract|internship'), false)",
    {"job_types": term_filter("job_type", ["contract", "internship"])},
    shown=_SHOWN + ", job_type")
_filter_query(
    "work_model", "coalesce(is_remote IN (false), false)",
    {"work_models": work_model_filter(["onsite"])}, shown=_SHOWN + ", is_remote")
_filter_query(
    "filters_combined",
    "coalesce(degree_bin IN (0, 2, 3, 6, 7), false) AND is_remote "
    "AND NOT coalesce(contains(lower(title), 'nurse'), false) "
    "AND coalesce(contains(lower(job_type), 'fulltime'), false)",
    {
        "degree_level": degree_filter("master"),
        "work_models": work_model_filter(["remote"]),
        "title_exclude": term_filter("title", ["nurse"], invert=True),
        "job_types": term_filter("job_type", ["fulltime"]),
    },
    derived=True)


_filter_query(
    "degree_level", "degree_bin IN (0, 1, 3, 7)", {"degree_level": degree_filter("bachelor")},
    derived=True, shown=_SHOWN + ", degree_bin")


@query("mask_join", over_postings(
    f"SELECT {_SHOWN} FROM postings WHERE company IN "
    "(SELECT c_name FROM customer WHERE c_acctbal > 5000) AND site NOT IN "
    "(SELECT CASE WHEN n_nationkey = 3 THEN 'indeed' ELSE n_name END FROM nation)"))
def mask_join(spark, sf):
    """Rows flagged by one mask table and not flagged by another."""
    rich = table(spark, sf, "customer").select(
        F.col("c_name").alias("company"), (F.col("c_acctbal") > 5000).alias("flag"))
    blocked = table(spark, sf, "nation").select(
        F.when(F.col("n_nationkey") == 3, "indeed").otherwise(F.col("n_name")).alias("site"),
        F.lit(True).alias("flag"))
    registry = {"rich": Mask(rich, "company", "flag"),
                "blocked": Mask(blocked, "site", "flag", invert=True)}
    return apply_filters(postings(spark, sf), registry).select(*_SHOWN.split(", "))


@query("recent", over_postings(
    f"SELECT {_SHOWN} FROM postings WHERE date_posted >= "
    f"CAST(DATE '{AS_OF}' - 365 AS VARCHAR)"))
def recent_rows(spark, sf):
    rows = postings(spark, sf)
    return rows.where(recent(F.col("date_posted"), AS_OF, 365)).select(*_SHOWN.split(", "))


@query("hours_old", over_postings(
    f"SELECT {_SHOWN} FROM postings WHERE CAST(date_posted AS DATE) >= "
    f"CAST(TIMESTAMP '{AS_OF} 10:30:00' - INTERVAL 1000 HOUR AS DATE)"))
def hours_old(spark, sf):
    rows = postings(spark, sf)
    fresh = newer_than_hours(F.col("date_posted"), f"{AS_OF} 10:30:00", 1000)
    return rows.where(fresh).select(*_SHOWN.split(", "))


_TOGGLES = """
toggles AS (SELECT 'p-' || CAST(o.o_orderkey AS VARCHAR) AS id, e.value > 10 AS flag,
                   e.ts AS toggled, e.event_id
            FROM events e JOIN orders o ON o.o_orderkey = e.user_id * 7 + e.event_id % 997),
latest AS (SELECT id, flag FROM (SELECT *, row_number() OVER
             (PARTITION BY id ORDER BY toggled DESC, event_id DESC) AS rn FROM toggles) WHERE rn = 1)"""


def _toggles(spark, sf):
    events = table(spark, sf, "events")
    keyed = events.select(
        (F.col("user_id") * 7 + F.col("event_id") % 997).alias("o_orderkey"),
        (F.col("value") > 10).alias("flag"), F.struct("ts", "event_id").alias("toggled_at"))
    return keyed.join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select(
        F.concat(F.lit("p-"), F.col("o_orderkey").cast("string")).alias("id"),
        "flag", "toggled_at")


def _favorite_postings(spark, sf):
    rows = postings(spark, sf).withColumn("is_favorite", F.lit(False))
    return with_favorites(rows, _toggles(spark, sf))


def _over_toggles(body: str) -> str:
    return over_postings("").rstrip() + f", {_TOGGLES} {body}"


@query("toggle_favorites", _over_toggles(
    f"SELECT {_SHOWN}, coalesce(flag, false) AS is_favorite "
    "FROM postings LEFT JOIN latest USING (id)"))
def toggle_favorites(spark, sf):
    """Favourite flags after every toggle recorded in the event log."""
    return _favorite_postings(spark, sf).select(*_SHOWN.split(", "), "is_favorite")


@query("favorites_view", _over_toggles(
    f"SELECT {_SHOWN} FROM postings JOIN latest USING (id) WHERE flag"))
def favorites_view(spark, sf):
    rows = active(_favorite_postings(spark, sf), AS_OF, 1, only_favorites=True)
    return rows.select(*_SHOWN.split(", "))


@query("boolean_search", over_postings(
    f"SELECT {_SHOWN} FROM postings WHERE "
    "(coalesce(contains(lower(title), 'data engineer'), false) OR "
    "(coalesce(contains(lower(description), 'doctoral'), false) "
    "AND coalesce(contains(lower(title), 'scientist'), false))) "
    "AND NOT (coalesce(contains(lower(title), 'junior'), false) "
    "OR coalesce(contains(lower(description), 'junior'), false))"))
def boolean_search(spark, sf):
    """"data engineer" OR (doctoral AND scientist), AND NOT junior."""
    wanted = all_of(
        any_of(mentions("data engineer", "title"),
               all_of(mentions("doctoral", "description"), mentions("scientist", "title"))),
        none_of(mentions("junior", "title", "description")))
    return postings(spark, sf).where(wanted).select(*_SHOWN.split(", "))


SEARCHES = {
    "doctor_data": '"data engineer" AND ("ph.d." OR doctoral) NOT junior',
    "nurse_manager": 'nurse OR "Program Manager" AND baltimore',
    "plain_scientist": "NOT (senior OR staff) scientist",
    "developer": "C++ developer (mba OR NOT (bachelor OR OFFICE))",
    "quoted_words": '"and" NOT "or"',
}


def _has(term: str) -> str:
    return (f"(coalesce(contains(lower(title), '{term}'), false) "
            f"OR coalesce(contains(lower(description), '{term}'), false))")


@query("search_string", over_postings(
    f"SELECT ord, {_has('data engineer')} AND ({_has('ph.d.')} OR {_has('doctoral')}) AND NOT {_has('junior')} "
    f"AS doctor_data, {_has('nurse')} OR ({_has('program manager')} AND {_has('baltimore')}) AS nurse_manager, "
    f"NOT ({_has('senior')} OR {_has('staff')}) AND {_has('scientist')} AS plain_scientist, "
    f"{_has('c++')} AND {_has('developer')} AND ({_has('mba')} OR NOT ({_has('bachelor')} OR {_has('office')})) "
    f"AS developer, {_has('and')} AND NOT {_has('or')} AS quoted_words FROM postings"))
def search_string(spark, sf):
    """Which postings each of several search strings matches."""
    return with_searches(postings(spark, sf), SEARCHES).select("ord", *SEARCHES)
