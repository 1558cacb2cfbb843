"""Deduplication, merge and archive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dedup import (
    GROUP, affected_leaves, exact_distinct, strict_anti)
from ..operators.details import aligned_records
from ..operators.filters import active, apply_filters, degree_filter
from ..operators.metrics import merge_metrics
from ..plans.fixture import AS_OF, postings
from ..plans.merge import (
    batch_leaves, ingest, merge_batch, merged_table, raw_archive_leaves, single_pass)
from ..schema import CRITERIA, DERIVED, POSTING_COLS
from ..sources.archive import append_segment, compact, read_archive, read_csv_archive
from ..sources.storage import compact_writer, fresh_path, shuffles_dropped, temporary
from ..streaming.update import start_updates
from .base import _DERIVED, _PLACES, over_postings, over_postings_and, query

COLS = ["id", "site", "job_url_direct", "title", "company", "location", "date_posted", "job_type",
        "is_remote", "min_amount", "max_amount", "currency", "interval", "description"]
LISTED = [c for c in COLS if c not in ("company", "description")]
_QUOTED = [f'"{c}"' for c in COLS]


def _merged_value(column: str) -> str:
    if column == "date_posted":
        return "max(date_posted) AS date_posted"
    if column == "description":
        return ("arg_min(description, CASE WHEN description IS NOT NULL THEN "
                "ord - CAST(length(description) AS BIGINT) * 10000000000 END) AS description")
    return f'arg_max("{column}", ord) FILTER (WHERE "{column}" IS NOT NULL) AS "{column}"'


def pass_sql(source: str, out: str, criterion: str, group_nulls: bool = False) -> str:
    """CTEs that merge ``source`` on one criterion; ``ord`` numbers the rows before and after."""
    keys = CRITERIA[criterion]
    missing = " OR ".join(f"{k} IS NULL" for k in keys)
    if group_nulls:
        passed = "false"
        group = " || ".join(f"coalesce('k' || md5({k}), 'n')" for k in keys)
    else:
        passed = f"({missing})"
        group = f"CASE WHEN {missing} THEN 'r' || ord ELSE {' || '.join(f'md5({k})' for k in keys)} END"
    values = ", ".join(_merged_value(c) for c in COLS)
    order = ", ".join(f"CASE WHEN NOT passed THEN {k} END NULLS LAST" for k in keys)
    return f"""
{out}_keyed AS (SELECT *, {group} AS g, {passed} AS passed FROM {source}),
{out}_merged AS (
  SELECT g, bool_or(passed) AS passed, min(ord) AS was, {values}, CAST(sum(n) AS BIGINT) AS n,
         flatten(list(members ORDER BY ord)) AS members
  FROM {out}_keyed GROUP BY g),
{out} AS (
  SELECT {', '.join(_QUOTED)}, n, members,
         row_number() OVER (ORDER BY passed, {order}, was) AS ord FROM {out}_merged)"""


def merge_sql(source: str, out: str, group_nulls: bool = False) -> str:
    steps, last = [], source
    for i, criterion in enumerate(CRITERIA, start=1):
        name = out if i == len(CRITERIA) else f"{out}_p{i}"
        steps.append(pass_sql(last, name, criterion, group_nulls))
        last = name
    return ",".join(steps)


_LEAVES = "leaves AS (SELECT *, CAST(1 AS BIGINT) AS n, [ord] AS members FROM postings)"
_SAME = " AND ".join(f'a."{c}" IS NOT DISTINCT FROM b."{c}"' for c in LISTED)
_TOUCH = " OR ".join(
    f"EXISTS (SELECT 1 FROM fresh f WHERE "
    + " AND ".join(f"f.{k} = a.{k}" for k in keys) + ")" for keys in CRITERIA.values())


def update_sql(archive: str, out: str, group_nulls: bool = False) -> str:
    """CTEs that merge the odd-numbered leaves into ``archive``."""
    return f"""
batch AS (SELECT * FROM leaves WHERE ord % 2 = 1),
fresh AS (SELECT * FROM batch b WHERE NOT EXISTS (SELECT 1 FROM {archive} a WHERE {_SAME})),
touched AS (SELECT * FROM {archive} a WHERE {_TOUCH}),
untouched AS (SELECT * FROM {archive} WHERE ord NOT IN (SELECT ord FROM touched)),
joint AS (
  SELECT {', '.join(_QUOTED)}, n, members, ord FROM fresh UNION ALL
  SELECT {', '.join(_QUOTED)}, n, members, ord + 1000000000 FROM touched),
{merge_sql('joint', 'grown', group_nulls)},
{out} AS (
  SELECT {', '.join(_QUOTED)}, n, members FROM grown UNION ALL
  SELECT {', '.join(_QUOTED)}, n, members FROM untouched)"""


_HALF = "half AS (SELECT * FROM leaves WHERE ord % 2 = 0)"
_SHOW = ", ".join(_QUOTED) + ", n AS n_instances"


def halves(spark, sf):
    """Odd rows as the new batch, even rows as the archive."""
    rows = postings(spark, sf)
    return rows.where(F.col("ord") % 2 == 1), rows.where(F.col("ord") % 2 == 0)


_COARSE = ["location", "job_type", "is_remote", "currency", "interval"]


def _coarse(spark, sf):
    return postings(spark, sf).select("ord", "company", *_COARSE)


_COARSE_SQL = ", ".join(f'"{c}"' for c in _COARSE)


@query("exact_distinct", over_postings(
    f"SELECT ord, company, {_COARSE_SQL} FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY {_COARSE_SQL} ORDER BY ord) AS rn FROM postings) WHERE rn = 1"))
def exactly_distinct(spark, sf):
    """Few distinct combinations, so every group is hot; the first row of each is kept."""
    return exact_distinct(_coarse(spark, sf), "ord")


@query("strict_anti", over_postings(
    f"SELECT ord, {_COARSE_SQL} FROM postings b WHERE ord % 2 = 1 AND NOT EXISTS ("
    "SELECT 1 FROM (SELECT * FROM postings WHERE ord % 55 < 40) a WHERE "
    + " AND ".join(f'a."{c}" IS NOT DISTINCT FROM b."{c}"' for c in _COARSE) + ")"))
def strictly_new(spark, sf):
    """Batch rows unknown to an archive that lacks some combinations."""
    rows = _coarse(spark, sf)
    fresh = strict_anti(rows.where(F.col("ord") % 2 == 1), rows.where(F.col("ord") % 55 < 40))
    return fresh.select("ord", *_COARSE)


_TOUCHED = (
    f"leaves AS (SELECT * FROM postings), fresh AS (SELECT * FROM leaves WHERE ord % 2 = 1), "
    f"archive AS (SELECT * FROM leaves WHERE ord % 2 = 0), "
    f"touched AS (SELECT * FROM archive a WHERE {_TOUCH})")


def _touched(spark, sf):
    batch, archive = halves(spark, sf)
    old = raw_archive_leaves(archive)
    return old.withColumn("ord", F.substring("_leaf", 3, 20).cast("long")), affected_leaves(
        old, batch_leaves(batch))


@query("affected_rows", over_postings_and(_TOUCHED, "SELECT ord, id, company, title FROM touched"))
def affected_rows(spark, sf):
    old, touched = _touched(spark, sf)
    return old.join(touched, "_leaf", "left_semi").select("ord", "id", "company", "title")


@query("static_rows", over_postings_and(
    _TOUCHED, "SELECT ord, id, company, title FROM archive WHERE ord NOT IN "
    "(SELECT ord FROM touched)"))
def static_rows(spark, sf):
    old, touched = _touched(spark, sf)
    return old.join(touched, "_leaf", "left_anti").select("ord", "id", "company", "title")


def _pass_query(criterion):
    name = f"dedup_pass_{criterion}"
    ctes = _LEAVES + "," + pass_sql("leaves", "merged", criterion)

    @query(name, over_postings_and(ctes, f"SELECT {_SHOW} FROM merged"))
    def run(spark, sf):
        return single_pass(postings(spark, sf), criterion)


for _criterion in CRITERIA:
    _pass_query(_criterion)


@query("dedup_merge", over_postings_and(
    f"{_LEAVES}, {_HALF}, {update_sql('half', 'updated')}", f"SELECT {_SHOW} FROM updated"))
def dedup_merge(spark, sf):
    """The whole merge of a batch into an archive; rows with a null key stay apart."""
    return merged_table(*halves(spark, sf))


@query("dedup_merge_null_groups", over_postings_and(
    f"{_LEAVES}, {_HALF}, {update_sql('half', 'updated', True)}", f"SELECT {_SHOW} FROM updated"))
def dedup_merge_null_groups(spark, sf):
    """The same with null keys forming one group per pass: the hottest keys there can be."""
    return merged_table(*halves(spark, sf), null_keys=GROUP)


_FIRST = f"{_LEAVES}, {merge_sql('leaves', 'merged')}"


@query("first_merge", over_postings_and(_FIRST, f"SELECT {_SHOW} FROM merged"))
def first_merge(spark, sf):
    return merged_table(postings(spark, sf))


def _aggregate_query(name, column):
    ctes = _LEAVES + "," + pass_sql("leaves", "merged", "company_title")

    @query(name, over_postings_and(
        ctes, f'SELECT company, title, "{column}", n AS n_instances FROM merged'))
    def run(spark, sf):
        return single_pass(postings(spark, sf), "company_title").select(
            "company", "title", column, "n_instances")


_aggregate_query("agg_latest_date", "date_posted")
_aggregate_query("agg_longest_text", "description")
_aggregate_query("agg_last_valid", "max_amount")


def ingested(spark, sf):
    return ingest(postings(spark, sf), html=False)


@query("agg_lists", over_postings_and(
    f"{_FIRST}, flat AS (SELECT id AS posting, unnest(members) AS member, "
    "generate_subscripts(members, 1) AS instance FROM merged)",
    "SELECT posting, instance, p.id, nullif(p.site, '') AS site, p.title, p.date_posted, "
    "p.max_amount FROM flat JOIN postings p ON p.ord = member"))
def merged_lists(spark, sf):
    """Every merged posting's instances in list order, one row each."""
    segment = merge_batch(postings(spark, sf), 1)
    owners = segment.postings.select("posting_id", F.col("id").alias("posting"))
    return aligned_records(segment.instances).join(owners, "posting_id").select(
        "posting", F.col("instance").cast("bigint"), "id", "site", "title", "date_posted",
        "max_amount")


def _stored(spark, *batches):
    """Merge batches one by one through an archive on disk; the archive after each."""
    path = fresh_path(spark, "archive")
    versions = []
    for n, batch in enumerate(batches, start=1):
        known = versions[-1] if versions else None
        with temporary(spark):
            segment = merge_batch(batch, n) if known is None else merge_batch(
                batch, n, known.postings, known.instances)
            append_segment(spark, path, segment, n)
        versions.append(read_archive(spark, path))
    return versions


@query("archive_roundtrip", over_postings_and(
    _FIRST, "SELECT id, title, company, date_posted, max_amount, false AS is_favorite, "
    "n AS n_instances, n AS stored_instances FROM merged"))
def archive_roundtrip(spark, sf):
    """A first merge written to an archive and read back from its files."""
    archive = _stored(spark, ingested(spark, sf))[-1]
    stored = archive.instances.groupBy("posting_id").agg(F.count("*").alias("stored_instances"))
    return archive.postings.join(stored, "posting_id").select(
        "id", "title", "company", "date_posted", "max_amount", "is_favorite", "n_instances",
        "stored_instances")


_TWICE = (f"{_LEAVES}, {_HALF}, {merge_sql('half', 'older')}, {update_sql('older', 'updated')}")


_UPDATED = over_postings_and(
    _TWICE, "SELECT id, site, job_url_direct, title, company, date_posted, max_amount, "
    "description, n AS n_instances FROM updated")


def _shown(archive):
    return archive.postings.select(
        "id", "site", "job_url_direct", "title", "company", "date_posted", "max_amount",
        "description", "n_instances")


@query("archive_update", _UPDATED)
def archive_update(spark, sf):
    """Two batches merged one after the other through an archive on disk."""
    batch, archive = halves(spark, sf)
    return _shown(_stored(spark, ingest(archive, html=False), ingest(batch, html=False))[-1])


@query("compacted_update", _UPDATED)
def compacted_update(spark, sf):
    """The same with the archive compacted between the two merges and after them."""
    batch, archive = halves(spark, sf)
    path = fresh_path(spark, "archive")
    with temporary(spark):
        append_segment(spark, path, merge_batch(ingest(archive, html=False), 1), 1)
        compact(spark, path)
        known = read_archive(spark, path)
        append_segment(spark, path, merge_batch(
            ingest(batch, html=False), 2, known.postings, known.instances), 2)
    compact(spark, path)
    return _shown(read_archive(spark, path))


@query("merge_metrics", over_postings_and(
    _TWICE, "SELECT (SELECT count(*) FROM updated) - (SELECT count(*) FROM older) AS new_postings, "
    "(SELECT count(*) FROM batch) - ((SELECT count(*) FROM updated) - (SELECT count(*) FROM older)) "
    "AS duplicates, (SELECT count(*) FROM updated) AS archive_size"))
def counted_merge(spark, sf):
    batch, archive = halves(spark, sf)
    before, after = _stored(spark, ingest(archive, html=False), ingest(batch, html=False))
    return merge_metrics(before.postings, batch, after.postings)


@query("stream_update", _UPDATED)
def stream_update(spark, sf):
    """Files landing in two rounds, merged by a stream that resumes where it stopped."""
    landing, path, checkpoint = (fresh_path(spark, n) for n in ("landing", "archive", "stream"))
    batch, archive = halves(spark, sf)
    for half in (archive, batch):
        kept = [c for c in half.columns if c in POSTING_COLS]
        with shuffles_dropped(spark):
            compact_writer(half.orderBy("ord").select(*kept)).mode("append").parquet(landing)
        start_updates(spark, landing, path, checkpoint, html=False).awaitTermination()
    return _shown(read_archive(spark, path))


_CSV_TEXT = "'two \"lines\",' || chr(10) || title || chr(10) || substr(description, 1, 200)"


@query("csv_archive", over_postings(
    f"SELECT id, title, company, location, min_amount, is_remote, {_CSV_TEXT} AS description, "
    "id || '|' || 'it''s ' || company AS id_list FROM postings"))
def csv_archive(spark, sf):
    """An archive in CSV files, with quotes, line breaks and lists, imported in splits; every task writes its file."""
    path = fresh_path(spark, "csv")
    rows = postings(spark, sf).select(
        "id", "title", "company", "location", "min_amount", "is_remote",
        F.expr(_CSV_TEXT.replace("chr(10)", "'\\n'")).alias("description"),
        F.concat(F.lit("['"), "id", F.lit("', \"it's "), "company", F.lit('"]')).alias("id_list"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_csv_archive(spark, path).withColumn("id_list", F.array_join("id_list", "|"))


_MERGED_POSTINGS = (
    f"SELECT * FROM ({over_postings_and(_FIRST, 'SELECT id, title, location, description, date_posted FROM merged')})")


@query("archive_view", (
    f"WITH postings AS (SELECT *, row_number() OVER () AS ord FROM ({_MERGED_POSTINGS})), {_PLACES}, {_DERIVED} "
    "SELECT id, title, date_posted, city, state, has_ba, has_ma, has_phd, degree_bin FROM derived "
    f"WHERE date_posted >= CAST(DATE '{AS_OF}' - 730 AS VARCHAR) AND degree_bin IN (0, 2, 3, 6, 7)"))
def archive_view(spark, sf):
    """The recent postings of an archive on disk, by the derived columns that it stores."""
    archive = _stored(spark, ingested(spark, sf))[-1]
    view = apply_filters(active(archive.postings, AS_OF, 730), {"degree": degree_filter("master")})
    return view.select("id", "title", "date_posted", *DERIVED.fieldNames())
