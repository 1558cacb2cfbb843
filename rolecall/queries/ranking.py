"""Derived columns, scores, sort orders and table projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.degrees import has_bachelor, has_doctorate, has_master, slashless
from ..functions.location import parse_location
from ..operators.keywords import keyword_scores, term_table
from ..operators.metrics import url_columns, width_thresholds
from ..operators.numbering import row_numbers
from ..operators.projection import labelled, list_columns, rendered, visible
from ..operators.scoring import degree_score, derive, rank_order_score, with_keywords
from ..operators.sorting import standard_order, stored_order
from ..plans.fixture import AS_OF, postings, table
from ..plans.rank import rank, score_profiles, scored_view
from ..schema import DEFAULT_COLUMNS, DEFAULT_LABELS, INSTANCE_COLS, list_name
from ..sources.html_report import FOOT, html_rows, read_report, report_head, write_report
from ..sources.profiles import Profile
from ..sources.storage import fresh_path
from .base import over_derived, over_derived_and, over_postings, over_postings_and, query, quoted

SITES = ["linkedin", "indeed"]
STATE_ORDER = ["TX", "CA", "NC"]
TERMS = {1: ["data", r"c\+\+", "ph\\.?d"], 0: ["degree"], -1: ["intern", r"\bnurse\b"]}

FLAGSHIP = Profile(
    sites_selected=SITES, max_age_days=730, degree_level="master",
    job_types=["fulltime", "parttime"], title_exclude_selected=["nurse"],
    title_require_selected=["data engineer", "scientist", "developer"],
    degree_values=(0, 5, -3), location_order_selected=STATE_ORDER,
    prioritized_terms_selected=TERMS[1], unprioritized_terms_selected=TERMS[0],
    deprioritized_terms_selected=TERMS[-1])
PROFILES = {
    "flagship": FLAGSHIP,
    "bachelor": Profile(sites_selected=["LinkedIn"], degree_values=(5, -3, -3),
                        location_order_selected=["OH", "MO"],
                        prioritized_terms_selected=["manager", "analyst"]),
    "plain": Profile(),
}


def _order_score(column: str, order: list[str]) -> str:
    cases = " ".join(f"WHEN {quoted(v)} THEN {len(order) - i}" for i, v in enumerate(order))
    return f"CAST(CASE {column} {cases} WHEN '' THEN -1 ELSE 0 END AS INT)"


def _degree_score(weights) -> str:
    ba, ma, phd = weights
    return (f"CAST(CAST(has_ba AS INT) * ({ba}) + CAST(has_ma AS INT) * ({ma}) "
            f"+ CAST(has_phd AS INT) * ({phd}) AS INT)")


def _re2(term: str) -> str:
    """A term in RE2, whose word boundary knows ASCII words only."""
    if r"\b" in term:
        word = r"\p{L}\p{N}_"
        inner = term.replace(r"\b", "")
        return f"(?i)(?:^|[^{word}]){inner}(?:[^{word}]|$)"
    return "(?i)" + term


def _hit(term: str) -> str:
    pattern = quoted(_re2(term))
    return (f"(coalesce(regexp_matches(title, {pattern}), false) OR "
            f"coalesce(regexp_matches(description, {pattern}), false))")


def _keyword_score(terms) -> str:
    parts = [f"CASE WHEN {_hit(t)} THEN {w} ELSE 0 END" for w, ts in terms.items() for t in ts]
    return f"CAST({' + '.join(parts) or '0'} AS INT)"


def _keywords(terms) -> str:
    parts = [f"CASE WHEN {_hit(t)} THEN {quoted(t.replace(chr(92), ''))} END"
             for ts in terms.values() for t in ts]
    return f"concat_ws(', ', {', '.join(parts)})" if parts else "''"


def _scored(profile: Profile, source: str = "derived") -> str:
    return f"""SELECT *, {_order_score('site', profile.sites_selected) if profile.sites_selected
        else "CAST(CASE site WHEN '' THEN -1 ELSE 0 END AS INT)"} AS site_score,
      {_order_score('state', profile.location_order_selected) if profile.location_order_selected
        else "CAST(CASE state WHEN '' THEN -1 ELSE 0 END AS INT)"} AS location_score,
      {_degree_score(profile.degree_values)} AS degree_score,
      {_keyword_score(profile.scored_terms)} AS keyword_score,
      {_keywords(profile.scored_terms)} AS keywords FROM {source}"""


@query("parse_location", over_derived("SELECT ord, location, city, state FROM derived"))
def parsed_locations(spark, sf):
    place = parse_location(F.col("location"))
    return postings(spark, sf).select("ord", "location", place.alias("p")).select(
        "ord", "location", "p.city", "p.state")


@query("parse_degrees", over_derived("SELECT ord, has_ba, has_ma, has_phd FROM derived"))
def parsed_degrees(spark, sf):
    text = slashless(F.col("description"))
    return postings(spark, sf).select(
        "ord", has_bachelor(text).alias("has_ba"), has_master(text).alias("has_ma"),
        has_doctorate(text).alias("has_phd"))


@query("degree_bins", over_derived(
    "SELECT degree_bin, count(*) AS n FROM derived GROUP BY degree_bin"))
def degree_bins(spark, sf):
    return derive(postings(spark, sf)).groupBy("degree_bin").agg(F.count("*").alias("n"))


@query("derived_columns", over_derived(
    "SELECT ord, id, city, state, has_ba, has_ma, has_phd, degree_bin FROM derived"))
def derived_columns(spark, sf):
    return derive(postings(spark, sf)).select(
        "ord", "id", "city", "state", "has_ba", "has_ma", "has_phd", "degree_bin")


@query("location_score", over_derived(
    f"SELECT ord, state, {_order_score('state', STATE_ORDER)} AS location_score FROM derived"))
def location_score(spark, sf):
    return derive(postings(spark, sf)).select(
        "ord", "state", rank_order_score(F.col("state"), STATE_ORDER).alias("location_score"))


@query("site_score", over_postings(
    f"SELECT ord, site, {_order_score('site', SITES)} AS site_score, "
    f"{_order_score('lower(site)', SITES)} AS any_case_score FROM postings"))
def site_score(spark, sf):
    return postings(spark, sf).select(
        "ord", "site", rank_order_score(F.col("site"), SITES).alias("site_score"),
        rank_order_score(F.col("site"), SITES, case_insensitive=True).alias("any_case_score"))


@query("degree_score", over_derived(
    f"SELECT ord, {_degree_score((5, -3, -3))} AS degree_score FROM derived"))
def degree_scores(spark, sf):
    return derive(postings(spark, sf)).select("ord", degree_score((5, -3, -3)).alias("degree_score"))


@query("keyword_score", over_postings(
    f"SELECT ord, {_keyword_score(TERMS)} AS keyword_score FROM postings"))
def keyword_score(spark, sf):
    return with_keywords(postings(spark, sf), TERMS).select("ord", "keyword_score")


@query("matched_keywords", over_postings(
    f"SELECT ord, {_keywords(TERMS)} AS keywords FROM postings"))
def matched_keywords(spark, sf):
    return with_keywords(postings(spark, sf), TERMS).select(
        "ord", F.array_join("keywords", ", ").alias("keywords"))


# Fifty search terms: plain words, phrases and regular expressions.
FIFTY_TERMS = {
    1: ["data", "engineer", "scientist", "analyst", "developer", "manager", "nurse", "senior",
        "staff", "junior", r"c\+\+", "intern", "degree", "doctoral", "preferred",
        "required", "advanced", "python", "spark", "sql"],
    0: ["office", "baltimore", "bachelor", "master", r"ph\.?d", "mba", "kubernetes", "docker",
        "terraform", "airflow", "java", "scala", "rust", "golang", "react"],
    -1: ["clearance", "on call", "travel", "unpaid", "night shift", "commission", "cold call",
         r"\bsales\b", r"door.to.door", "weekend", "temporary", "contract", "part time",
         "relocation", "overtime"],
}


@query("keyword_score_50", over_postings(
    f"SELECT ord, {_keyword_score(FIFTY_TERMS)} AS keyword_score, {_keywords(FIFTY_TERMS)} AS keywords FROM postings"))
def keyword_score_50(spark, sf):
    """Fifty terms as a table, looked up by the texts' words."""
    rows = postings(spark, sf).select("ord", "title", "description")
    return keyword_scores(rows, term_table(spark, FIFTY_TERMS), "ord").withColumn(
        "keywords", F.array_join("keywords", ", "))


# Words of five letters and more of the benchmark items, and such a word with the one after it.
_ITEM_WORDS = """words AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
each AS (SELECT w[i] AS one, w[i + 1] AS other FROM words, unnest(range(1, len(w) + 1)) AS t(i) WHERE length(w[i]) > 4),
listed AS (SELECT one AS term FROM each UNION SELECT one || ' ' || other FROM each WHERE other IS NOT NULL),
terms AS (SELECT term, row_number() OVER (ORDER BY term) AS place, length(term) % 3 - 1 AS weight FROM listed)"""


@query("keyword_score_many", over_postings_and(
    f"""{_ITEM_WORDS},
texts AS (SELECT title AS text FROM postings UNION SELECT description FROM postings),
held AS (SELECT text, list(place) AS places FROM texts JOIN terms ON contains(lower(text), term) GROUP BY text),
hits AS (
  SELECT ord, unnest(list_distinct(list_concat(coalesce(t.places, []), coalesce(d.places, [])))) AS place
  FROM postings LEFT JOIN held t ON t.text = title LEFT JOIN held d ON d.text = description),
sums AS (SELECT ord, CAST(sum(weight) AS INT) AS score, count(*) AS n FROM hits JOIN terms USING (place) GROUP BY ord)""",
    "SELECT ord, coalesce(score, 0) AS keyword_score, CAST(coalesce(n, 0) AS INT) AS n_keywords "
    "FROM postings LEFT JOIN sums USING (ord)"))
def keyword_score_many(spark, sf):
    """Some thousand terms, words and phrases, as a table."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    pairs = F.transform("w", lambda x, i: F.struct(x.alias("one"), F.get("w", i + 1).alias("other")))
    each = table(spark, sf, "benchmark").select(words.alias("w")).select(F.inline(pairs)).where(F.length("one") > 4)
    both = F.array_compact(F.array("one", F.concat("one", F.lit(" "), "other")))
    listed = each.select(F.explode(both).alias("term")).distinct()
    terms = row_numbers(listed, [F.col("term")], "place").withColumn("weight", F.length("term") % 3 - 1)
    rows = postings(spark, sf).select("ord", "title", "description")
    return keyword_scores(rows, terms, "ord").select(
        "ord", "keyword_score", F.size("keywords").alias("n_keywords"))


_SCORES = "date_posted, location_score, degree_score, keyword_score, site_score"
_DESCENDING = ", ".join(f"{c} DESC NULLS LAST" for c in _SCORES.split(", "))


@query("ranked_view", over_derived_and(
    f"scored AS ({_scored(FLAGSHIP)}), "
    f"view AS (SELECT * FROM scored WHERE date_posted >= CAST(DATE '{AS_OF}' - 730 AS VARCHAR) "
    "AND degree_bin IN (0, 2, 3, 6, 7) "
    "AND coalesce(regexp_matches(job_type, '(?i)fulltime|parttime'), false) "
    "AND NOT coalesce(regexp_matches(title, '(?i)nurse'), false) "
    "AND coalesce(regexp_matches(title, '(?i)data engineer|scientist|developer'), false))",
    f"SELECT ord, id, title, {_SCORES}, keywords, "
    f"row_number() OVER (ORDER BY {_DESCENDING}, id, ord) AS rank FROM view"))
def ranked_view(spark, sf):
    """Recent postings of the flagship profile, filtered, scored and ranked."""
    view = scored_view(postings(spark, sf), FLAGSHIP, AS_OF).select(
        "ord", "id", "title", *_SCORES.split(", "), F.array_join("keywords", ", ").alias("keywords"))
    return row_numbers(view, standard_order(tiebreak=("id", "ord")))


def _all_scored(spark, sf):
    block = score_profiles(derive(postings(spark, sf)), {"flagship": FLAGSHIP})
    return block.select("ord", "id", "title", *_SCORES.split(", "))


@query("standard_order", over_derived_and(
    f"scored AS ({_scored(FLAGSHIP)})",
    f"SELECT ord, id, {_SCORES}, "
    f"row_number() OVER (ORDER BY {_DESCENDING}, id, ord) AS rank FROM scored"))
def ranked_by_standard_order(spark, sf):
    return row_numbers(_all_scored(spark, sf).drop("title"), standard_order(tiebreak=("id", "ord")))


@query("lead_column_order", over_derived_and(
    f"scored AS ({_scored(FLAGSHIP)})",
    "SELECT ord, id, title, keyword_score, row_number() OVER (ORDER BY title NULLS LAST, "
    f"{_DESCENDING}, id, ord) AS by_title, row_number() OVER (ORDER BY keyword_score NULLS LAST, "
    f"{_DESCENDING.replace('keyword_score DESC NULLS LAST, ', '')}, id, ord) AS by_keywords "
    "FROM scored"))
def lead_column_order(spark, sf):
    """Rank with the title leading, and with the keyword score moved to the front."""
    keys = ("id", "ord")
    by_title = row_numbers(
        _all_scored(spark, sf), standard_order("title", True, keys), "by_title")
    by_both = row_numbers(by_title, standard_order("keyword_score", True, keys), "by_keywords")
    return by_both.select("ord", "id", "title", "keyword_score", "by_title", "by_keywords")


_LEADING = r"'^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)'"


def _typed_order(column: str, direction: str = "ASC") -> str:
    """DuckDB sort keys of a text cell: kind, number, collated text."""
    text = f"lower(trim({column}))"
    number = f"TRY_CAST(regexp_extract({text}, {_LEADING}, 1) AS DOUBLE)"
    key = f"icu_sort_key({text}, 'und')"
    kind = (f"CASE WHEN {column} IS NULL THEN NULL WHEN {number} IS NOT NULL THEN 1 "
            f"WHEN {key} < icu_sort_key('0', 'und') THEN 0 ELSE 2 END")
    keys = (kind, number, f"CASE WHEN {number} IS NULL THEN {key} END")
    return ", ".join(f"{k} {direction} NULLS LAST" for k in keys)


@query("typed_multi_sort", over_postings(
    f"SELECT ord, title, min_amount, row_number() OVER (ORDER BY {_typed_order('job_type', 'DESC')}, "
    f"{_typed_order('title')}, min_amount DESC NULLS LAST, ord) AS rank FROM postings"))
def typed_multi_sort(spark, sf):
    rows = postings(spark, sf).select("ord", "job_type", "title", "min_amount")
    rows, order = stored_order(rows, [("job_type", False), ("title", True), ("min_amount", False)])
    return row_numbers(rows, [*order, F.col("ord")]).select("ord", "title", "min_amount", "rank")


# Cells with accents, case, signs, numbers and numbers with units.
_CELLS_OF = ["Émile", "emile", "EMIL", "Zoë", "zoe", "ångström", "Ångstrom", "10 km", "9", "9 lives", "-3.5", ".5x", "(draft)",
             "_hidden", "", "straße", "Strasse", "ñandú", "nandu", "1e3", " élan", "e-mail"]
_CELL_SQL = ("CASE ord % 23 " + " ".join(f"WHEN {i} THEN {quoted(c)}" for i, c in enumerate(_CELLS_OF)) + " END")


@query("locale_order", over_postings(
    f"SELECT ord, cell, row_number() OVER (ORDER BY {_typed_order('cell')}, ord) AS up, "
    f"row_number() OVER (ORDER BY {_typed_order('cell', 'DESC')}, ord) AS down "
    f"FROM (SELECT ord, {_CELL_SQL} AS cell FROM postings)"))
def locale_order(spark, sf):
    """Mixed cells in the order of the locale, both ways."""
    rows = postings(spark, sf).select("ord", F.expr(_CELL_SQL).alias("cell"))
    rows, upwards = stored_order(rows, [("cell", True)])
    _, downwards = stored_order(rows, [("cell", False)])
    up = row_numbers(rows, [*upwards, F.col("ord")], "up")
    return row_numbers(up, [*downwards, F.col("ord")], "down").select("ord", "cell", "up", "down")


_PROFILE_ROWS = " UNION ALL ".join(
    f"SELECT ord, {quoted(name)} AS profile, site_score, location_score, degree_score, "
    f"keyword_score, keywords FROM ({_scored(p)})" for name, p in PROFILES.items())


@query("multi_profile_scores", over_derived(_PROFILE_ROWS))
def multi_profile_scores(spark, sf):
    scored = score_profiles(derive(postings(spark, sf)), PROFILES)
    return scored.select(
        "ord", "profile", "site_score", "location_score", "degree_score", "keyword_score",
        F.array_join("keywords", ", ").alias("keywords"))


@query("visible_columns", over_derived_and(
    f"scored AS ({_scored(FLAGSHIP)})",
    "SELECT NULL::VARCHAR AS is_favorite, date_posted, state, company, title, has_ba, has_ma, "
    "has_phd, keywords, site FROM scored"))
def visible_columns(spark, sf):
    """The default columns; the favourite flag is unknown here and shows as null."""
    rows = score_profiles(derive(postings(spark, sf)), {"flagship": FLAGSHIP})
    return visible(rows.withColumn("keywords", F.array_join("keywords", ", ")), DEFAULT_COLUMNS)


@query("labelled_columns", over_derived(
    'SELECT date_posted AS "Date Posted   ", state AS "State ", company AS "Company ", '
    'title AS "Title  ", has_phd AS "PhD", job_type AS "Job Type", degree_bin AS "Degree Bin" '
    "FROM derived"))
def labelled_columns(spark, sf):
    rows = derive(postings(spark, sf)).select(
        "date_posted", "state", "company", "title", "has_phd", "job_type", "degree_bin")
    return labelled(rows, DEFAULT_LABELS)


_CELLS = ("ord", "is_favorite", "is_remote", "title", "site_list", "job_type_list")


@query("rendered_cells", over_postings(
    "SELECT CAST(ord AS VARCHAR) AS ord, CASE WHEN o_flag THEN '★' ELSE '☆' END AS is_favorite, "
    "CASE WHEN is_remote THEN '◆' ELSE '' END AS is_remote, title, coalesce(site, '') AS site_list, "
    "coalesce(job_type, '') AS job_type_list FROM (SELECT *, ord % 2 = 0 AS o_flag FROM postings)"))
def rendered_cells(spark, sf):
    rows = list_columns(postings(spark, sf)).withColumn("is_favorite", F.col("ord") % 2 == 0)
    return rendered(rows.select(*_CELLS))


_LISTED = [c for c in INSTANCE_COLS if c in (
    "id", "site", "job_url_direct", "date_posted", "title", "location", "is_remote", "job_type",
    "currency", "interval")]


@query("list_init", over_postings("SELECT ord, " + ", ".join(
    f"CASE WHEN \"{c}\" IS NULL THEN 0 ELSE 1 END AS \"{c}_size\", "
    f"coalesce(CAST(\"{c}\" AS VARCHAR), '') AS \"{c}_list\"" for c in _LISTED) + " FROM postings"))
def list_init(spark, sf):
    rows = list_columns(postings(spark, sf))
    shown = ["ord"]
    for c in _LISTED:
        lists = F.col(list_name(c))
        shown += [F.size(lists).alias(f"{c}_size"),
                  F.array_join(lists.cast("array<string>"), ", ").alias(f"{c}_list")]
    return rows.select(*shown)


def _threshold(column: str, length: str, source: str) -> str:
    return (
        f"SELECT '{column}' AS column_name, CAST(CASE WHEN max(n) <= 80 THEN 80 ELSE "
        f"coalesce(max(n) FILTER (WHERE (n - m) / s <= 2), 80) END AS INT) AS threshold FROM "
        f"(SELECT {length} AS n, avg({length}) OVER () AS m, stddev_samp({length}) OVER () AS s "
        f"FROM {source})")


@query("width_threshold", over_postings(" UNION ALL ".join([
    _threshold("company", "length(company)", "postings"),
    _threshold("title", "length(title)", "postings"),
    _threshold("description", "length(description)", "postings"),
    _threshold("words", "length(description)",
               "(SELECT replace(description, ' ', '  ') AS description FROM postings "
               "WHERE description IS NOT NULL)"),
])))
def width_threshold_rows(spark, sf):
    rows = postings(spark, sf).withColumn("words", F.split("description", " "))
    return width_thresholds(rows, ["company", "title", "description", "words"])


@query("url_column_test", over_postings(
    "SELECT bool_or(coalesce(starts_with(title, 'http'), false)) AS title, "
    "bool_or(coalesce(starts_with(job_url_direct, 'http'), false)) AS job_url_direct, "
    "bool_or(coalesce(starts_with(description, 'http'), false)) AS description FROM postings"))
def url_column_test(spark, sf):
    return url_columns(postings(spark, sf).select("ord", "title", "job_url_direct", "description"))


_ESCAPE = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


_HTML_ROW = (
    "'<tr><td>' || CASE WHEN is_remote THEN '✕' ELSE '' END || "
    "'</td><td data-posted_key=\"' || CAST(epoch(posted) AS BIGINT) || '\">' || "
    "strftime(posted, '%m/%d') || '</td><td data-company_key=\"' || "
    + _ESCAPE.format("company") + " || '\">' || CASE WHEN job_url_direct IS NULL THEN '' ELSE "
    "'<a href=\"' || " + _ESCAPE.format("job_url_direct") + " || '\" target=\"_blank\" "
    "rel=\"noopener noreferrer\">' || " + _ESCAPE.format("company") + " || '</a>' END || "
    "'</td><td>' || " + _ESCAPE.format("title") + " || '</td></tr>'")
_DATED = "dated AS (SELECT *, strptime(date_posted, '%Y-%m-%d') AS posted FROM postings)"
_HEADERS = {"is_remote": "Remote", "posted": "Posted", "job_url_direct": "Link", "title": "Title"}
_SORT_KEYS = {"posted": "posted", "job_url_direct": "company"}


def _dated(spark, sf):
    return postings(spark, sf).withColumn("posted", F.col("date_posted").cast("timestamp"))


@query("html_rows", over_postings_and(_DATED, f"SELECT ord, {_HTML_ROW} AS row FROM dated"))
def html_table_rows(spark, sf):
    return html_rows(_dated(spark, sf), _HEADERS, _SORT_KEYS).select("ord", "row")


@query("html_report", over_postings_and(
    _DATED, f"SELECT 0 AS part, {quoted(report_head(_HEADERS, _SORT_KEYS))} AS line UNION ALL "
    f"SELECT 1, {_HTML_ROW} FROM dated UNION ALL SELECT 2, {quoted(FOOT)}"))
def html_report(spark, sf):
    """A report written by the sink and read back: head, rows and foot."""
    path = fresh_path(spark, "report")
    write_report(_dated(spark, sf), path, _HEADERS, _SORT_KEYS)
    return read_report(spark, path).select(F.substring("file", 1, 1).cast("int").alias("part"), "line")


def flagship(spark, sf):
    """Postings ranked for the flagship profile, as the library returns them."""
    view = rank(postings(spark, sf), FLAGSHIP, AS_OF)
    return view.select("id", "title", "company", "city", "state", *_SCORES.split(", "),
                       F.array_join("keywords", ", ").alias("keywords"))

