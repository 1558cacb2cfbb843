"""Texts of merged rows: of equal texts one crosses the network, whatever points at it."""

from collections import Counter

from rolecall.operators import dedup
from rolecall.operators.dedup import leaf_texts, leaves, merge_pass, position_token, with_texts

from pyspark.sql import functions as F


def _leaves(rows):
    return leaves(rows, F.concat(F.lit("b:"), F.col("ord").cast("string")), position_token(0, F.lit(0), F.col("ord")))


def _texts(rows):
    return leaf_texts(rows, F.concat(F.lit("b:"), F.col("ord").cast("string")))


def test_equal_texts_are_shuffled_once(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id AS ord", "'p-' || id AS id", "'text ' || id % 7 AS description")
    sent = []

    def watched(*args):
        sent.append(thinned(*args))
        return sent[-1]

    thinned = dedup.thinned
    monkeypatch.setattr(dedup, "thinned", watched)
    found = with_texts(merge_pass(_leaves(rows), "id"), _texts(rows)).select("id", "description").collect()
    assert len(sent) == 1 and sent[0].count() < 50
    assert sorted(found) == sorted((f"p-{i}", f"text {i % 7}") for i in range(3000))


def test_missing_texts_and_leaves_that_repeat(spark):
    data = [(1, "a", "x"), (2, "b", "x"), (3, "c", None), (None, "d", "x"), (4, "e", ""), (5, "f", "y"), (5, "g", "x")]
    rows = spark.createDataFrame(data, "ord long, id string, description string")
    found = with_texts(merge_pass(_leaves(rows), "id"), _texts(rows)).select("id", "description").collect()
    # a leaf that several rows have has the texts of them all, a row without a place has no values
    assert Counter(map(tuple, found)) == Counter(
        [("a", "x"), ("b", "x"), ("c", None), (None, None), ("e", "")]
        + [(i, t) for i in "fg" for t in "xy"])
