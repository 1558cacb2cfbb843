"""Favourite flags kept beside the archive as an append-only table of toggles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def toggled(viewed: DataFrame, at: Column) -> DataFrame:
    """Toggle records for viewed rows: the negation of what each row showed."""
    shown = F.coalesce("is_favorite", F.lit(False))
    return viewed.select("id", (~shown).alias("flag"), at.alias("toggled_at"))


def latest_flags(toggles: DataFrame) -> DataFrame:
    """The flag each posting id was last given."""
    return toggles.groupBy("id").agg(F.max_by("flag", "toggled_at").alias("_flag"))


def with_favorites(postings: DataFrame, toggles: DataFrame) -> DataFrame:
    """Every posting with a toggled id takes that id's latest flag."""
    flagged = postings.join(latest_flags(toggles), "id", "left")
    flag = F.coalesce("_flag", "is_favorite", F.lit(False))
    return flagged.withColumn("is_favorite", flag).select(*postings.columns)
