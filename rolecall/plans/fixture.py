"""Posting rows derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POSTINGS_SQL = """
SELECT 'p-' || CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey - o_orderkey % 5
                         ELSE o_orderkey END AS STRING) AS id,
 o_orderkey AS ord,
 CASE o_orderkey % 4 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' WHEN 2 THEN 'LinkedIn'
   ELSE '' END AS site,
 CASE WHEN o_orderkey % 3 = 0
   THEN 'https://careers.example.com/' || CAST(o_orderkey % 997 AS STRING) END AS job_url_direct,
 (CASE o_orderkey % 5 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Staff ' WHEN 2 THEN 'Junior '
   ELSE '' END) ||
 (CASE o_orderkey % 6 WHEN 0 THEN 'Data Engineer' WHEN 1 THEN 'C++ Developer'
   WHEN 2 THEN 'ML Scientist' WHEN 3 THEN 'Data Analyst (Intern)'
   WHEN 4 THEN 'Program Manager' ELSE 'Nurse' END) AS title,
 c_name AS company,
 CASE o_orderkey % 11 WHEN 0 THEN 'Austin, TX, USA' WHEN 1 THEN 'austin, texas'
   WHEN 2 THEN 'Remote' WHEN 3 THEN 'USA' WHEN 4 THEN 'California'
   WHEN 5 THEN 'O''Fallon, MO' WHEN 6 THEN 'Winston-Salem, North Carolina, US'
   WHEN 7 THEN 'Paris, France' WHEN 8 THEN 'a, b, c, d' WHEN 9 THEN 'Ohio, United States'
   END AS location,
 CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_posted,
 CASE o_orderkey % 5 WHEN 0 THEN 'fulltime' WHEN 1 THEN 'parttime'
   WHEN 2 THEN 'fulltime, contract' WHEN 3 THEN 'internship' END AS job_type,
 o_orderkey % 3 = 0 AS is_remote,
 o_totalprice AS min_amount,
 CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice + 10000 END AS max_amount,
 'usd' AS currency,
 CASE o_orderkey % 5 WHEN 0 THEN 'yearly' WHEN 1 THEN 'hourly' WHEN 2 THEN 'daily'
   WHEN 3 THEN 'monthly' ELSE 'weekly' END AS {interval},
 (CASE o_orderkey % 8 WHEN 0 THEN 'BS/MS in CS required. ' WHEN 1 THEN 'Ph.D. preferred. '
   WHEN 2 THEN 'Bachelor''s degree. ' WHEN 3 THEN 'MBA or advanced degree. '
   WHEN 4 THEN 'Baltimore, MD office. ' WHEN 5 THEN 'M.A. or B.A. or doctoral. '
   ELSE '' END) || d.text AS description
FROM (SELECT *, o_orderkey % (SELECT max(doc_id) + 1 FROM {documents}) AS doc_no FROM {orders})
JOIN {customer} ON o_custkey = c_custkey
LEFT JOIN {documents} d ON d.doc_id = doc_no
"""

# The last order date of the test tables, used wherever the current time would be.
AS_OF = "2001-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a table stored in few splits over as many partitions as a shuffle has.

    The number is given, so that adaptive execution does not merge small keys into one partition whose
    rows then meet their long texts in a single task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.columns[0])


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per order, with the order key as batch order ``ord``."""
    names = ("orders", "customer", "documents")
    sql = POSTINGS_SQL.format(interval="`interval`", **{n: "{" + n + "}" for n in names})
    tables = {n: table(spark, sf_dir, n) for n in names}
    tables["orders"] = spread(tables["orders"])
    return spark.sql(sql, **tables)


def oracle_postings() -> str:
    """The same rows as a DuckDB subquery."""
    return POSTINGS_SQL.format(
        interval='"interval"', orders="orders", customer="customer", documents="documents")
