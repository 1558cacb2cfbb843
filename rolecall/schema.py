"""Column names, types and the fixed column groups of the posting data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The posting record, one field per column.
POSTING = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("site", T.StringType()),
    T.StructField("job_url", T.StringType()),
    T.StructField("job_url_direct", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("date_posted", T.StringType()),
    T.StructField("job_type", T.StringType()),
    T.StructField("salary_source", T.StringType()),
    T.StructField("interval", T.StringType()),
    T.StructField("min_amount", T.DoubleType()),
    T.StructField("max_amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("is_remote", T.BooleanType()),
    T.StructField("job_level", T.StringType()),
    T.StructField("job_function", T.StringType()),
    T.StructField("listing_type", T.StringType()),
    T.StructField("emails", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("company_industry", T.StringType()),
    T.StructField("company_url", T.StringType()),
    T.StructField("company_logo", T.StringType()),
    T.StructField("company_url_direct", T.StringType()),
    T.StructField("company_addresses", T.StringType()),
    T.StructField("company_num_employees", T.StringType()),
    T.StructField("company_revenue", T.StringType()),
    T.StructField("company_description", T.StringType()),
    T.StructField("skills", T.StringType()),
    T.StructField("experience_range", T.StringType()),
    T.StructField("company_rating", T.StringType()),
    T.StructField("company_reviews_count", T.StringType()),
    T.StructField("vacancy_count", T.StringType()),
    T.StructField("work_from_home_type", T.StringType()),
])
POSTING_COLS = POSTING.fieldNames()

# Columns made from the texts of a posting.
DERIVED = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("city", "state")]
    + [T.StructField(c, T.BooleanType()) for c in ("has_ba", "has_ma", "has_phd")]
    + [T.StructField("degree_bin", T.IntegerType())])

# The fields kept once per collected source posting.
INSTANCE_COLS = [
    "id", "site", "job_url", "job_url_direct", "date_posted", "title", "location",
    "is_remote", "job_type", "job_level", "min_amount", "max_amount", "currency",
    "interval", "skills", "experience_range", "work_from_home_type",
]

# Duplicate criteria, in the order the merge applies them.
CRITERIA = {
    "id": ["id"],
    "url": ["job_url_direct"],
    "company_title": ["company", "title"],
    "title_desc": ["title", "description"],
}

# Columns of the job record and of the company record.
JOB_COLS = [
    "id", "site", "job_url", "job_url_direct", "title", "company", "location",
    "date_posted", "job_type", "interval", "min_amount", "max_amount", "currency",
    "is_remote", "job_level", "job_function", "description", "skills",
    "experience_range", "work_from_home_type",
]
COMPANY_COLS = [
    "company", "emails", "company_industry", "company_url", "company_logo",
    "company_url_direct", "company_addresses", "company_num_employees",
    "company_revenue", "company_description", "company_rating",
    "company_reviews_count", "vacancy_count",
]

# Default table columns, their labels and the standard order.
DEFAULT_COLUMNS = [
    "is_favorite", "date_posted", "state", "company", "title",
    "has_ba", "has_ma", "has_phd", "keywords", "site",
]
DEFAULT_LABELS = {
    "is_favorite": "", "date_posted": "Date Posted   ", "state": "State ",
    "company": "Company ", "title": "Title  ", "has_ba": "BA ", "has_ma": "MA ",
    "has_phd": "PhD",
}
STANDARD_ORDER = [
    "date_posted", "location_score", "degree_score", "keyword_score", "site_score",
]


def list_name(column: str) -> str:
    return f"{column}_list"


def is_text(column: str) -> bool:
    """Long-text columns, which merge by length and are moved through shuffles by reference."""
    return column.endswith("description")


def conform(df: DataFrame) -> DataFrame:
    """Give ``df`` every posting column with its declared type; extra columns stay."""
    present = set(df.columns)
    wanted = [
        f"CAST({f'`{f.name}`' if f.name in present else 'NULL'} AS {f.dataType.simpleString()}) "
        f"AS `{f.name}`"
        for f in POSTING
    ]
    return df.selectExpr(*wanted, *[f"`{c}`" for c in df.columns if c not in POSTING_COLS])
