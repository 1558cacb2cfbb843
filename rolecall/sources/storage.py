"""Shared folder for checkpoints and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..schema import is_text

# A finished query's shuffle files go at once, instead of when the driver happens to collect garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_DICTIONARY = 64 << 20  # bytes of different texts that a Parquet column chunk holds once each

_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    A local session without one gets a scratch folder of its own; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    scratch = tempfile.mkdtemp(prefix="rolecall-")
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files; for writes, which nothing reads by its shuffles again."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


@contextmanager
def temporary(spark: SparkSession, keep: tuple[str, ...] = ()) -> Iterator[None]:
    """Tables spooled inside are deleted at the end, but for those whose label is to be kept.

    Whoever opened a wider scope deletes the kept ones.
    """
    inner: list[str] = []
    outer = _written.get()
    token = _written.set(inner)
    try:
        yield
    finally:
        _written.reset(token)
        for path in inner:
            if path.rpartition("/")[2].rpartition("-")[0] not in keep:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            elif outer is not None:
                outer.append(path)


def compact_writer(df: DataFrame):
    """A writer of Parquet files in which equal texts of a column chunk are held once."""
    writer = df.write.option("compression", "zstd")
    return writer.option("parquet.dictionary.page.size", _DICTIONARY) if any(map(is_text, df.columns)) else writer


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from the files."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spool(df: DataFrame, label: str) -> DataFrame:
    """The same with as little left on disk as can be: a compact table, no shuffle files, and see ``temporary``."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    if (written := _written.get()) is not None:
        written.append(path)
    with shuffles_dropped(spark):
        compact_writer(df).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
