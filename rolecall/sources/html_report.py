"""HTML table rows of a posting table, and a sink that writes them as one report.

The report is a data source writer: every task writes its rows to a part of its own, and only when all
have, the commit adds the head, the foot and a list of the files in reading order. Parts are numbered as the
table's partitions, so a sorted table reads in its order. A report that fails leaves no parts behind.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.metrics import url_columns

# Sort key of a missing date, in seconds.
_NO_DATE = -9223372037


def _escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _is_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _text(column: str, kind: T.DataType) -> Column:
    value = F.col(column)
    if isinstance(kind, T.BooleanType):
        return F.when(value, "True").when(~value, "False").otherwise("")
    if isinstance(kind, T.ArrayType):
        return F.coalesce(_escaped(F.array_join(value.cast("array<string>"), ", ")), F.lit(""))
    return F.coalesce(_escaped(value.cast("string")), F.lit(""))


def html_rows(
    df: DataFrame, headers: Mapping[str, str], keys: Mapping[str, str] | None = None,
    links: set[str] | None = None,
) -> DataFrame:
    """One ``row`` of HTML per posting, next to the columns it came from.

    ``links`` names the columns shown as anchors; by default those with any URL in them, which the query
    finds out as it runs.
    """
    keys = keys or {}
    texts = {c for c in headers if isinstance(df.schema[c].dataType, T.StringType)}
    any_url = url_columns(df.select(*headers))
    cells = []
    for column in headers:
        kind, value = df.schema[column].dataType, F.col(column)
        key = keys.get(column)
        if isinstance(kind, T.BooleanType):
            body = F.when(value, "✕").otherwise("")
        elif _is_date(kind):
            body = F.coalesce(F.date_format(column, "MM/dd"), F.lit(""))
        elif column in (texts if links is None else links):
            label = _text(key, df.schema[key].dataType) if key else F.lit("link")
            body = F.when(
                value.startswith("http"),
                F.concat(F.lit('<a href="'), _escaped(value),
                         F.lit('" target="_blank" rel="noopener noreferrer">'), label, F.lit("</a>")),
            ).otherwise("")
            if links is None:
                body = F.when(any_url.select(column).scalar(), body).otherwise(_text(column, kind))
        else:
            body = _text(column, kind)
        if key:
            key_kind = df.schema[key].dataType
            sort_key = _text(key, key_kind)
            if _is_date(kind) and _is_date(key_kind):
                seconds = F.unix_timestamp(F.col(key).cast("timestamp"))
                sort_key = F.coalesce(seconds, F.lit(_NO_DATE)).cast("string")
            opened = F.concat(F.lit(f'<td data-{key}_key="'), sort_key, F.lit('">'))
        else:
            opened = F.lit("<td>")
        cells += [opened, body, F.lit("</td>")]
    return df.select("*", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("row"))


@dataclass
class Part(WriterCommitMessage):
    """A part that a task has written."""

    name: str
    rows: int


class ReportWriter(DataSourceWriter):
    """Writes the text column of a table between a head and a foot."""

    def __init__(self, path: str, head: str, foot: str):
        self.path, self.head, self.foot = path, head, foot

    def _files(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def write(self, iterator: Iterator[Row]) -> Part:
        files, folder = self._files()
        files.create_dir(folder)
        task = TaskContext.get()
        name, rows = f"1-part-{task.partitionId():08d}-{task.taskAttemptId()}.html", 0
        with files.open_output_stream(f"{folder}/{name}") as out:
            for row in iterator:
                out.write(f"{row[0]}\n".encode())
                rows += 1
        return Part(name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        files, folder = self._files()
        files.create_dir(folder)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.name)
        for name, line in (("0-head.html", self.head), ("2-foot.html", self.foot)):
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write(f"{line}\n".encode())
        listed = {"files": ["0-head.html", *(m.name for m in parts), "2-foot.html"], "rows": sum(m.rows for m in parts)}
        with files.open_output_stream(f"{folder}/report.json") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list[Part | None]) -> None:
        files, folder = self._files()
        for found in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if found.base_name.startswith("1-part-"):
                files.delete_file(found.path)


class ReportSource(DataSource):
    """``df.write.format("html_report")`` with the options ``path``, ``head`` and ``foot``."""

    @classmethod
    def name(cls) -> str:
        return "html_report"

    def writer(self, schema: T.StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], self.options.get("head", ""), self.options.get("foot", ""))


FOOT = "</tbody></table></body></html>"


def report_head(headers: Mapping[str, str], keys: Mapping[str, str]) -> str:
    titles = "".join(
        f'<th data-sort-key="{keys[c]}_key">{h}</th>' if keys.get(c) else f"<th>{h}</th>"
        for c, h in headers.items())
    return f"<!DOCTYPE html><html><body><table><thead><tr>{titles}</tr></thead><tbody>"


def write_report(
    df: DataFrame, path: str, headers: Mapping[str, str], keys: Mapping[str, str] | None = None
) -> None:
    """Write a report of ``df``, in its row order, to a folder that does not hold one yet."""
    spark, keys = df.sparkSession, keys or {}
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/report.json")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        raise FileExistsError(f"a report is already there: {path}")
    spark.dataSource.register(ReportSource)
    rows = html_rows(df, headers, keys).select("row")
    rows.write.format("html_report").mode("append").options(
        path=path, head=report_head(headers, keys), foot=FOOT).save()


def read_report(spark, path: str) -> DataFrame:
    """(file, line) of a written report."""
    return spark.read.text(f"{path}/*.html").select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
