"""Text jobs over documents, sectioned descriptions and web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import clean_description
from ..functions.sections import LABEL_RULES, extract_headers, label, sections
from ..functions.text import drop_non_ascii, html_to_markdown, title_case, to_ascii
from ..plans.fixture import spread, table
from .base import query, quoted, titled

# Sample section headers, two or more for every label.
HEADERS = [
    "Travel Requirements", "Equal Opportunity Employer", "How to Apply", "Salary & Benefits",
    "Pay Range: $90,000", "About the Company", "Job Family", "Security Clearance", "Job ID 12345",
    "Hybrid Schedule", "Physical Demands", "Nice to Have", "Minimum Qualifications",
    "Skills and Experience", "Key Responsibilities", "Job Description", "Software Engineering",
    "Additional Information", "Our Mission", "Locations", "Work", "Date Posted", "Notes",
    "https links", "Something Else", "What You'll Bring", "Day in the Life", "Reports to: VP",
    "The Challenge", "Who we are",
]
_HEADER_ROWS = ", ".join(f"({i}, {quoted(h)})" for i, h in enumerate(HEADERS))

_SECTIONED_SQL = f"""
WITH heads(i, h) AS (VALUES {_HEADER_ROWS}),
sectioned AS (
  SELECT doc_id, 'Opening of ' || doc_id || chr(10) || '### ' || a.h || chr(10) || '* one' ||
    chr(10) || chr(10) || '### ' || b.h || ' ' || chr(10) || text AS md
  FROM documents JOIN heads a ON a.i = doc_id % {len(HEADERS)}
  JOIN heads b ON b.i = (doc_id * 7 + 3) % {len(HEADERS)}),
lines AS (
  SELECT doc_id, unnest(string_split(md, chr(10))) AS line,
         generate_subscripts(string_split(md, chr(10)), 1) AS spot FROM sectioned),
headers AS (
  SELECT doc_id, spot, trim(replace(line, '###', ''), ' ' || chr(9)) AS header FROM lines
  WHERE contains(line, '###'))"""


def sectioned(spark, sf):
    """Whole documents below an opening line and two section headers each."""
    names = F.array(*[F.lit(h) for h in HEADERS])

    def head(i):
        return F.get(names, (i % len(HEADERS)).cast("int"))

    doc = F.col("doc_id")
    md = F.concat(
        F.lit("Opening of "), doc.cast("string"), F.lit("\n### "), head(doc),
        F.lit("\n* one\n\n### "), head(doc * 7 + 3), F.lit(" \n"), F.col("text"))
    return documents(spark, sf).select("doc_id", md.alias("md"))


def documents(spark, sf):
    return spread(table(spark, sf, "documents"))


def _numbered_headers(spark, sf):
    return sectioned(spark, sf).select(
        "doc_id", F.posexplode(extract_headers(F.col("md"))).alias("header_no", "header"))


@query("headers", _SECTIONED_SQL + (
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS INT) "
    "AS header_no, header FROM headers"))
def headers(spark, sf):
    return _numbered_headers(spark, sf)


_LABELS = " ".join(
    f"WHEN regexp_matches(header, {quoted('(?i)' + pattern)}) THEN '{name}'"
    for name, pattern in LABEL_RULES)


@query("header_labels", _SECTIONED_SQL + (
    ", plain AS (SELECT doc_id, regexp_replace(header, '[^\\x00-\\x7F]', '', 'g') AS header "
    f"FROM headers) SELECT doc_id, header, CASE {_LABELS} ELSE '' END AS label FROM plain"))
def header_labels(spark, sf):
    """Labels of ASCII headers, as cleaned descriptions have them."""
    plain = _numbered_headers(spark, sf).select(
        "doc_id", drop_non_ascii(F.col("header")).alias("header"))
    return plain.select("doc_id", "header", label(F.col("header")).alias("label"))


@query("sections", _SECTIONED_SQL + """, parts AS (
  SELECT doc_id, spot, line, sum(CASE WHEN contains(line, '###') THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY spot) AS part FROM lines)
SELECT doc_id, CAST(part AS INT) AS section,
  coalesce(max(CASE WHEN contains(line, '###') THEN trim(line, ' ' || chr(9)) END), '') AS header,
  coalesce(trim(string_agg(CASE WHEN NOT contains(line, '###') THEN line END, chr(10) ORDER BY spot),
    ' ' || chr(10) || chr(9) || chr(13)), '') AS body
FROM parts GROUP BY doc_id, part""")
def document_sections(spark, sf):
    return sections(sectioned(spark, sf), "md", "doc_id").drop("label")


@query("title_case", f"SELECT doc_id, {titled('text')} AS titled FROM documents")
def title_cased(spark, sf):
    return documents(spark, sf).select("doc_id", title_case(F.col("text")).alias("titled"))


def _ascii_sql() -> str:
    """Decompositions of the accented letters the documents use."""
    marks = {
        "chr(768)": ("èÈ", "eE"), "chr(769)": ("éíóÉÍÓ", "eioEIO"), "chr(771)": ("ñÑ", "nN"),
        "chr(776)": ("äöüÄÖÜ", "aouAOU"), "chr(807)": ("çÇ", "cC"), "'^'": ("êÊ", "eE"),
    }
    text = "text"
    for mark, (accented, bases) in marks.items():
        for letter, base in zip(accented, bases):
            text = f"replace({text}, '{letter}', '{base}' || {mark})"
    return text


@query("to_ascii", f"SELECT doc_id, {_ascii_sql()} AS plain FROM documents")
def transliterated(spark, sf):
    return documents(spark, sf).select("doc_id", to_ascii(F.col("text")).alias("plain"))


@query("clean_description")
def cleaned(spark, sf):
    """Whole sectioned documents through every cleaning rule, split into labelled sections."""
    clean = sectioned(spark, sf).select("doc_id", clean_description(F.col("md")).alias("md"))
    return sections(clean, "md", "doc_id")


def _plain(html: str) -> str:
    """DuckDB expression for the markdown of text without tags; null if there is none."""
    text = html
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"),
                         ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    text = f"replace(replace({text}, '*', '\\*'), '_', '\\_')"
    return f"nullif(trim(regexp_replace({text}, '[ \\n\\r]+', ' ', 'g')), '')"


# The layout of the given pages: links, an advertisement, a title, paragraphs, some in bold and
# without end tags, and a footer.
_PAGES_SQL = f"""
WITH cut AS (
  SELECT page_id, url,
    regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1) AS hrefs,
    regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS names,
    regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS ad,
    regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS head,
    regexp_extract_all(html, '<p><b>[^<]*<br>|<p>[^<]*</p>') AS paragraphs,
    regexp_extract(html, '<footer>([^<]*)</footer>', 1) AS footer
  FROM pages)
SELECT page_id, url, concat_ws(chr(10) || chr(10),
    array_to_string(list_transform(list_zip(hrefs, names), lambda x:
      '* [' || {_plain("x[2]")} || '](' || x[1] || ' "' || x[1] || '")'), chr(10)),
    {_plain("ad")}, '# ' || {_plain("head")},
    nullif(array_to_string(list_filter(list_transform(paragraphs, lambda x:
      CASE WHEN starts_with(x, '<p><b>') THEN '__' || {_plain("x[7:-5]")} || '__'
      ELSE {_plain("x[4:-5]")} END), lambda x: x IS NOT NULL), chr(10) || chr(10)), ''),
    {_plain("footer")}) AS markdown
FROM cut"""


@query("pages_markdown", _PAGES_SQL)
def pages_markdown(spark, sf):
    pages = spread(table(spark, sf, "pages"))
    return pages.select("page_id", "url", html_to_markdown(F.col("html")).alias("markdown"))
