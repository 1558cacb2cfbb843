"""Named search profiles: defaults, JSON files, and the requests they ask for."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())

# Settings by page, with type and default.
PAGES: dict[str, dict[str, tuple[T.DataType, object]]] = {
    "collect": {
        "sites_selected": (_TEXTS, []),
        "locations_selected": (_TEXTS, []),
        "queries": (_TEXTS, []),
        "hours_old": (T.IntegerType(), 24),
    },
    "filter": {
        "max_age_days": (T.IntegerType(), 1),
        "degree_level": (T.StringType(), "none"),
        "work_models": (_TEXTS, []),
        "job_types": (_TEXTS, []),
        "title_exclude_selected": (_TEXTS, []),
        "title_require_selected": (_TEXTS, []),
        "descr_exclude_selected": (_TEXTS, []),
        "descr_require_selected": (_TEXTS, []),
    },
    "sort": {
        "degree_values": (T.ArrayType(T.IntegerType()), [0, 0, 0]),
        "location_order_selected": (_TEXTS, []),
        "prioritized_terms_selected": (_TEXTS, []),
        "unprioritized_terms_selected": (_TEXTS, []),
        "deprioritized_terms_selected": (_TEXTS, []),
    },
    "data": {"display_favorites": (T.BooleanType(), False)},
}
# Options every collection request carries.
REQUEST_OPTIONS = {"distance": 100, "results_wanted": 10_000, "description_format": "html"}

PROFILE_JSON = T.StructType([
    T.StructField(page, T.StructType([T.StructField(k, kind) for k, (kind, _) in keys.items()]))
    for page, keys in PAGES.items()
])


@dataclass
class Profile:
    """One profile's settings, as the read path uses them."""

    sites_selected: list[str] = field(default_factory=list)
    locations_selected: list[str] = field(default_factory=list)
    queries: list[str] = field(default_factory=list)
    hours_old: int = 24
    max_age_days: int = 1
    degree_level: str = "none"
    work_models: list[str] = field(default_factory=list)
    job_types: list[str] = field(default_factory=list)
    title_exclude_selected: list[str] = field(default_factory=list)
    title_require_selected: list[str] = field(default_factory=list)
    descr_exclude_selected: list[str] = field(default_factory=list)
    descr_require_selected: list[str] = field(default_factory=list)
    degree_values: tuple[int, int, int] = (0, 0, 0)
    location_order_selected: list[str] = field(default_factory=list)
    prioritized_terms_selected: list[str] = field(default_factory=list)
    unprioritized_terms_selected: list[str] = field(default_factory=list)
    deprioritized_terms_selected: list[str] = field(default_factory=list)
    display_favorites: bool = False

    @property
    def scored_terms(self) -> dict[int, list[str]]:
        return {
            1: self.prioritized_terms_selected,
            0: self.unprioritized_terms_selected,
            -1: self.deprioritized_terms_selected,
        }

    @classmethod
    def from_row(cls, row) -> Profile:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in row.asDict().items() if k in known})


def _default(kind: T.DataType, value: object) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.array(*[F.lit(v) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def with_defaults(parsed: DataFrame, *keep: str) -> DataFrame:
    """Flatten parsed pages to one column per setting; a missing key takes its default."""
    return parsed.select(*keep, *[
        F.coalesce(F.col(f"{page}.{key}"), _default(kind, value)).alias(key)
        for page, keys in PAGES.items() for key, (kind, value) in keys.items()])


def parse_profiles(texts: DataFrame, column: str, *keep: str) -> DataFrame:
    """Profiles from a column of JSON documents."""
    pages = F.from_json(column, PROFILE_JSON)
    names = [f.name for f in PROFILE_JSON]
    parsed = texts.select(*keep, pages.alias("_p")).select(
        *keep, *[F.col(f"_p.{n}").alias(n) for n in names])
    return with_defaults(parsed, *keep)


def read_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """One row per JSON file of a folder, named after the file."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    parsed = spark.read.schema(PROFILE_JSON).option("multiLine", True).json(folder)
    return with_defaults(parsed.withColumn("profile", name), "profile")


def write_profiles(profiles: DataFrame, folder: str) -> None:
    """Write profiles as page -> key -> value documents that hold their name, one a line."""
    pages = [F.struct(*keys).alias(page) for page, keys in PAGES.items()]
    profiles.select("profile", *pages).write.json(folder)


def read_written_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The profiles that ``write_profiles`` wrote."""
    schema = T.StructType([T.StructField("profile", T.StringType()), *PROFILE_JSON])
    return with_defaults(spark.read.schema(schema).json(folder), "profile")


def request_grid(profiles: DataFrame, *keep: str) -> DataFrame:
    """One row per query, location and site of each profile, sharing a request number."""
    return (
        profiles.select(*keep, "sites_selected", "locations_selected",
                        F.posexplode("queries").alias("query_no", "query"))
        .select(*keep, "sites_selected", "query_no", "query",
                F.posexplode("locations_selected").alias("location_no", "location"))
        .select(*keep, "query_no", "query", "location_no", "location",
                *[F.lit(v).alias(k) for k, v in REQUEST_OPTIONS.items()],
                F.explode("sites_selected").alias("site")))
