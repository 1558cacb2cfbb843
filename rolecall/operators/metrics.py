"""Run metrics and column statistics."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

# Default cell width, and how unusual a length may be before it is ignored.
WIDTH, MAX_Z = 80, 2


def shown_length(df: DataFrame, column: str) -> Column:
    """Characters a cell takes; list items are joined by two characters."""
    value = F.col(column)
    if isinstance(df.schema[column].dataType, T.ArrayType):
        items = F.transform(value.cast("array<string>"), lambda x: F.length(x))
        total = F.aggregate(items, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
        return total + 2 * (F.size(value) - 1)
    return F.length(value)


def width_thresholds(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: the width beyond which its cells wrap.

    WIDTH if nothing is longer, else the greatest length within MAX_Z standard deviations.
    The data is read once for all columns, into one row per column and length; the windows see
    only those.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), shown_length(df, c).cast("long").alias("len"))
        for c in columns])
    each = "OVER (PARTITION BY column_name)"
    lengths = df.select(F.inline(cells)).groupBy("column_name", "len").count()
    spread = lengths.selectExpr(
        "column_name", "len", "if(len IS NULL, 0, count) AS count",
    ).selectExpr(
        "*", f"sum(count) {each} AS n", f"sum(len * count) {each} AS total",
    ).selectExpr("column_name", "len", "n", "len - total / n AS off", "count").selectExpr(
        "column_name", "len", "off",
        f"sqrt(sum(off * off * count) {each} / nullif(n - 1, 0)) AS std")
    usual = F.max(F.when(F.col("off") / F.nullif("std", F.lit(0.0)) <= MAX_Z, F.col("len")))
    return spread.groupBy("column_name").agg(
        F.when(F.max("len") > WIDTH, F.coalesce(usual, F.lit(WIDTH)))
        .otherwise(WIDTH).cast("int").alias("threshold"))


def merge_metrics(before: DataFrame | None, batch: DataFrame, after: DataFrame) -> DataFrame:
    """One row: new postings, duplicates folded in, and archive size after a merge."""
    size = F.count(F.lit(1))
    old = F.lit(0) if before is None else before.select(size).scalar()
    collected = batch.select(size).scalar()
    found = (size - old).alias("new_postings")
    return after.agg(
        found, (collected - (size - old)).alias("duplicates"), size.alias("archive_size"))


def land_requests(
    requests: Sequence[tuple[str, str, DataFrame]], landing: str, file_format: str = "parquet"
) -> list[tuple[str | None, str | None, int, float]]:
    """Land each request's rows; (query, location, collected, seconds) of each, and of the run under nulls.

    Rows are counted by the job that writes them, so nothing is read twice.
    """
    found, began = [], time.monotonic()
    for number, (query, location, rows) in enumerate(requests):
        start, seen = time.monotonic(), Observation(f"request-{number}")
        rows.observe(seen, F.count(F.lit(1)).alias("collected")).write.mode("append").format(file_format).save(landing)
        found.append((query, location, seen.get["collected"], time.monotonic() - start))
    return [*found, (None, None, sum(f[2] for f in found), time.monotonic() - began)]


class Progress(StreamingQueryListener):
    """What each batch of a stream has read, and how long it took: (batch, rows, seconds)."""

    def __init__(self):
        self.batches: list[tuple[int, int, float]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        done = event.progress
        self.batches.append((done.batchId, done.numInputRows, done.batchDuration / 1000))

    def onQueryTerminated(self, event) -> None:
        pass


def request_counts(collected: DataFrame) -> DataFrame:
    """Rows collected per request, with the run total as the row of null query and location."""
    return (
        collected.groupingSets(
            [[F.col("query"), F.col("location")], []], F.col("query"), F.col("location"))
        .agg(F.count(F.lit(1)).alias("collected")))


def url_columns(df: DataFrame) -> DataFrame:
    """One row: for each string column, does any value start like a URL?"""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.agg(*[
        F.coalesce(F.bool_or(F.col(c).startswith("http")), F.lit(False)).alias(c) for c in texts])
