"""The CSV archive of the query is written by as many tasks as there are."""

from pyspark.sql import functions as F

from rolecall.operators.dedup import leaves, position_token
from rolecall.queries import merging


def test_csv_is_written_by_all_tasks(spark, monkeypatch):
    rows = spark.range(0, 90, 1, 3).selectExpr(
        "id AS ord", "'p-' || id AS id", "'t' || id AS title", "'c' AS company", "'Ohio' AS location",
        "CAST(id AS DOUBLE) AS min_amount", "id % 2 = 0 AS is_remote", "'long' AS description")
    files = []

    def watched(session, path):
        files.extend(f for f in session.read.text(path).inputFiles())
        return read(session, path)

    read = merging.read_csv_archive
    monkeypatch.setattr(merging, "postings", lambda *_: rows)
    monkeypatch.setattr(merging, "read_csv_archive", watched)
    found = {r["id"]: r for r in merging.csv_archive(spark, "").collect()}
    assert len(files) == 3 and len(found) == 90
    assert found["p-7"]["id_list"] == "p-7|it's c" and found["p-7"]["description"] == "two \"lines\",\nt7\nlong"


def test_digests_of_texts_are_bytes(spark):
    rows = spark.range(2).selectExpr("id AS ord", "'x' AS description")
    made = leaves(rows, F.col("ord").cast("string"), position_token(0, F.lit(0), F.col("ord")))
    assert made.schema["_ref_description"].dataType["sha"].dataType.simpleString() == "binary"
