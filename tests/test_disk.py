"""What merges leave on disk and send through shuffles."""

import os

from pyspark.sql import functions as F

from rolecall.operators import dedup
from rolecall.operators.dedup import exact_distinct, merge_pass, packed, unpacked
from rolecall.operators.key_filter import parted
from rolecall.plans.merge import batch_leaves, merge_batch
from rolecall.sources.archive import csv_records
from rolecall.sources.storage import shared_dir, spool, temporary


def _rows(spark, n):
    # every tenth row shares its id with the one before
    return spark.range(n).selectExpr(
        "id AS ord", "'p-' || (id - if(id % 10 = 1, 1, 0)) AS id", "'t' || id AS title", "'c' || id AS company",
        "if(id % 4 = 0, 'soon', '2024-01-01') AS date_posted", "'u' || id AS job_url_direct", "'text ' || id AS description")


def test_rows_that_are_alone_are_told_apart(spark):
    rows = spool(spark.range(4000).selectExpr("id", "if(id < 40, id % 20, if(id = 50, NULL, id)) AS key"), "rows")
    alone, met = parted(rows, F.col("key"), F.col("key").isNull())
    found = {r["id"] for r in met.collect()}
    assert found >= set(range(40)) | {50} and len(found) < 100
    assert sorted([*found, *(r["id"] for r in alone.collect())]) == list(range(4000))
    assert parted(rows, F.col("id"), F.lit(False)) == (rows, None)
    assert parted(rows, F.col("id") % 20, F.lit(False)) == (None, rows)


def test_rows_that_are_alone_are_not_shuffled(spark, monkeypatch):
    sent, grouped = [], dedup._grouped

    def watched(rows, *args):
        sent.append(rows.count())
        return grouped(rows, *args)

    monkeypatch.setattr(dedup, "_grouped", watched)
    merged = merge_pass(batch_leaves(_rows(spark, 2000)), "id").collect()
    assert len(sent) == 1 and 400 <= sent[0] < 500
    assert len(merged) == 1800 and sum(r["_n"] for r in merged) == 2000
    # a date that is none is left out, whether its row met another or not
    assert {r["date_posted"] for r in merged} == {None, "2024-01-01"}


def test_first_of_equal_rows_and_rows_without_a_place(spark):
    data = [(2, "a"), (1, "a"), (3, "b"), (None, "c"), (None, "a")]
    rows = spark.createDataFrame(data, "ord long, id string")
    assert sorted(map(tuple, exact_distinct(rows, "ord").collect()), key=str) == [(1, "a"), (3, "b"), (None, None)]


def test_names_of_groups_are_packed(spark):
    names = ["id:" + "0f" * 32, "title_desc:" + "a9" * 32, "b:17", "a:id:" + "0f" * 32 + "@3", "id:short", None]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", packed(F.col("name")).alias("p"))
    assert [r[0] for r in rows.select(unpacked(F.col("p"))).collect()] == names
    assert [r[0] for r in rows.select(F.length("p")).collect()][:3] == [33, 33, 5]


def test_a_merge_leaves_its_result_only(spark):
    before = set(os.listdir(shared_dir(spark)))
    segment = merge_batch(_rows(spark, 200), 1)
    new = sorted(n.rpartition("-")[0] for n in set(os.listdir(shared_dir(spark))) - before)
    assert new == ["sequenced", "sequenced"]
    found = segment.instances.collect()
    assert len(found) == 200 and {r["date_posted"] for r in found} == {"soon", "2024-01-01"}
    assert segment.postings.count() == 180


def test_scopes_of_temporary_tables(spark):
    with temporary(spark):
        with temporary(spark, keep=("kept",)):
            gone, kept = spool(spark.range(3), "gone"), spool(spark.range(3), "kept")
            folders = [f for f in os.listdir(shared_dir(spark)) if f.startswith(("gone-", "kept-"))]
            assert len(folders) == 2
        assert kept.count() == 3
        assert [f for f in folders if f in os.listdir(shared_dir(spark))] == [f for f in folders if f.startswith("kept-")]
    assert not [f for f in folders if f in os.listdir(shared_dir(spark))]


def test_records_of_csv_are_numbered_across_splits(spark, tmp_path, monkeypatch):
    path = tmp_path / "in.csv"
    records = ["a,b"] + [f'{i},"two\n""lines"" of {i}\n\nend"' for i in range(300)]
    path.write_text("\n".join(records) + "\n")
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    before = set(os.listdir(shared_dir(spark)))
    try:
        found = {r["no"]: r["record"] for r in csv_records(spark, str(path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)
    assert found == dict(enumerate(records, start=1))
    new = [n.rpartition("-")[0] for n in set(os.listdir(shared_dir(spark))) - before]
    assert new == ["placed"]
