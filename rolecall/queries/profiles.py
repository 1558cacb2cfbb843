"""Collection and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.metrics import land_requests, request_counts
from ..plans.fixture import AS_OF, postings, table
from ..plans.merge import ingest
from ..schema import POSTING_COLS
from ..sources.landing import append_batches, collected, read_landing
from ..sources.profiles import (
    parse_profiles, read_written_profiles, request_grid, write_profiles)
from ..sources.storage import fresh_path
from .base import over_postings, over_postings_and, query

_SHOWN = ("id", "site", "title", "company", "date_posted", "max_amount", "job_level")


def _profile_texts(spark, sf):
    """One settings document per customer, some keys left out."""
    named = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    third = F.col("c_custkey") % 3
    document = F.to_json(F.struct(
        F.struct(
            F.when(third != 0, F.array(F.lower("c_mktsegment"), F.lit("analyst"))).alias("queries"),
            F.array(F.col("n_name"), F.lit("Remote")).alias("locations_selected"),
            F.array(F.lit("linkedin"), F.lit("indeed")).alias("sites_selected"),
            F.when(third == 1, F.lit(72)).alias("hours_old")).alias("collect"),
        F.when(third == 2, F.struct(
            F.lit("master").alias("degree_level"),
            F.array(F.lit("remote")).alias("work_models"))).alias("filter"),
        F.when(third == 1, F.struct(
            F.array(F.lit(0), F.lit(5), F.lit(-3)).alias("degree_values"))).alias("sort")))
    return named.select(F.col("c_name").alias("profile"), document.alias("document"))


@query("profile_defaults", """
SELECT c_name AS profile,
  CASE WHEN c_custkey % 3 <> 0 THEN lower(c_mktsegment) || ',analyst' ELSE '' END AS queries,
  n_name || ',Remote' AS locations_selected, 'linkedin,indeed' AS sites_selected,
  CASE WHEN c_custkey % 3 = 1 THEN 72 ELSE 24 END AS hours_old, 1 AS max_age_days,
  CASE WHEN c_custkey % 3 = 2 THEN 'master' ELSE 'none' END AS degree_level,
  CASE WHEN c_custkey % 3 = 2 THEN 'remote' ELSE '' END AS work_models,
  CASE WHEN c_custkey % 3 = 1 THEN '0,5,-3' ELSE '0,0,0' END AS degree_values,
  '' AS prioritized_terms_selected, false AS display_favorites
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def profile_defaults(spark, sf):
    profiles = parse_profiles(_profile_texts(spark, sf), "document", "profile")
    lists = ("queries", "locations_selected", "sites_selected", "work_models", "degree_values",
             "prioritized_terms_selected")
    return profiles.select("profile", "hours_old", "max_age_days", "degree_level",
                           "display_favorites",
                           *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in lists])


@query("request_grid", """
SELECT c_name AS profile, q.no AS query_no,
  CASE q.no WHEN 0 THEN lower(c_mktsegment) ELSE 'analyst' END AS query, l.no AS location_no,
  CASE l.no WHEN 0 THEN n_name ELSE 'Remote' END AS location, 100 AS distance,
  10000 AS results_wanted, 'html' AS description_format, s.site
FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES (0), (1)) q(no),
  (VALUES (0), (1)) l(no), (VALUES ('linkedin'), ('indeed')) s(site)
WHERE c_custkey % 3 <> 0""")
def requests(spark, sf):
    """Query x location x site of every profile that has queries."""
    profiles = parse_profiles(_profile_texts(spark, sf), "document", "profile")
    return request_grid(profiles, "profile")


@query("ingest_defaults", over_postings_and(
    "raw AS (SELECT ord, id, CASE ord % 3 WHEN 0 THEN date_posted WHEN 1 THEN "
    "date_posted || ' 13:45:00' END AS date_posted, CASE WHEN ord % 4 <> 0 THEN min_amount END "
    "AS min_amount FROM postings)",
    "SELECT ord, id, substr(date_posted, 1, 10) AS date_posted, min_amount, "
    "false AS is_favorite FROM raw"))
def ingest_defaults(spark, sf):
    """Dates in two spellings, or missing, and NaN amounts."""
    third = F.col("ord") % 3
    raw = postings(spark, sf).withColumns({
        "date_posted": F.when(third == 0, F.col("date_posted")).when(
            third == 1, F.concat("date_posted", F.lit(" 13:45:00"))),
        "min_amount": F.when(F.col("ord") % 4 == 0, F.lit(float("nan"))).otherwise(
            F.col("min_amount")),
    })
    return ingest(raw, html=False).select("ord", "id", "date_posted", "min_amount", "is_favorite")


@query("collected_batch", over_postings(
    f"SELECT {', '.join(_SHOWN[:-1])}, NULL::VARCHAR AS job_level FROM postings "
    f"WHERE CAST(date_posted AS DATE) >= CAST(TIMESTAMP '{AS_OF} 12:00:00' "
    "- INTERVAL 9000 HOUR AS DATE)"))
def collected_batch(spark, sf):
    """Rows landed as JSON files, read back with the posting schema, old ones dropped."""
    landing = fresh_path(spark, "landing")
    rows = postings(spark, sf)
    rows.select(*[c for c in rows.columns if c in POSTING_COLS]).write.json(landing, compression="gzip")
    landed = read_landing(spark, landing, "json")
    return collected(landed, f"{AS_OF} 12:00:00", 9000).select(*_SHOWN)


@query("batch_append", over_postings(
    "SELECT id, title, company, NULL::VARCHAR AS job_level, "
    "CASE WHEN site = 'indeed' THEN NULL ELSE max_amount END AS max_amount FROM postings"))
def batch_append(spark, sf):
    """Two requests with different columns become one run."""
    rows = postings(spark, sf)
    one = rows.where(F.col("site") == "indeed").drop("max_amount", "ord")
    other = rows.where(F.col("site") != "indeed").drop("ord")
    return append_batches(one, other).select("id", "title", "company", "job_level", "max_amount")


@query("request_counts", over_postings(
    "SELECT query, location, count(*) AS collected FROM (SELECT coalesce(job_type, 'any type') "
    "AS query, coalesce(location, 'anywhere') AS location FROM postings) "
    "GROUP BY GROUPING SETS ((query, location), ())"))
def counted_requests(spark, sf):
    return request_counts(postings(spark, sf).select(
        F.coalesce("job_type", F.lit("any type")).alias("query"),
        F.coalesce("location", F.lit("anywhere")).alias("location")))


@query("profile_sink", "SELECT n_name AS profile, 24 AS hours_old, n_regionkey AS max_age_days, "
       "n_name || '|' || CAST(n_nationkey AS VARCHAR) AS locations, "
       "CASE WHEN n_nationkey % 2 = 0 THEN 'master' ELSE 'none' END AS degree_level FROM nation")
def profile_sink(spark, sf):
    """One profile per nation, written and read back; what is not set takes its default."""
    nations = table(spark, sf, "nation")
    texts = nations.select(F.col("n_name").alias("profile"), F.to_json(F.struct(
        F.struct(F.array("n_name", F.col("n_nationkey").cast("string")).alias(
            "locations_selected")).alias("collect"),
        F.struct(F.col("n_regionkey").alias("max_age_days"), F.when(
            F.col("n_nationkey") % 2 == 0, "master").alias("degree_level")).alias("filter"),
    )).alias("json"))
    folder = fresh_path(spark, "profiles")
    write_profiles(parse_profiles(texts, "json", "profile"), folder)
    return read_written_profiles(spark, folder).select(
        "profile", "hours_old", "max_age_days",
        F.array_join("locations_selected", "|").alias("locations"), "degree_level")


@query("request_metrics", over_postings(
    "SELECT coalesce(nullif(site, ''), 'any site') AS query, 'anywhere' AS location, count(*) AS collected, true AS timed "
    "FROM postings GROUP BY site UNION ALL SELECT NULL, NULL, count(*), true FROM postings"))
def request_metrics(spark, sf):
    """Rows and time of each request of a run that lands them, and of the whole run."""
    rows = postings(spark, sf)
    kept = rows.select(*[c for c in rows.columns if c in POSTING_COLS])
    requests = [(site or "any site", "anywhere", kept.where(F.col("site") == site))
                for site in ("linkedin", "indeed", "LinkedIn", "")]
    found = land_requests(requests, fresh_path(spark, "landing"))
    return spark.createDataFrame(found, "query string, location string, collected long, seconds double").select(
        "query", "location", "collected", (F.col("seconds") >= 0).alias("timed"))
