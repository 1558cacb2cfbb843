"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex that each vertex of (a, b) edges is connected to.

    Labels shrink to the smallest neighbouring label and then jump to their label's label, until none
    changes. Every round is written, so a round's joins have plain shuffles that adaptive execution
    can split at hubs, and minima combine before their shuffle.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(
        both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "v"), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("near")))
        met = materialize(labels.join(near, labels["v"] == near["a"]).select(
            "v", F.col("label").alias("old"), F.least("label", "near").alias("step")), "met")
        up = met.select(F.col("v").alias("up"), F.col("step").alias("jump"))
        moved = materialize(met.join(up, met["step"] == up["up"]).select(
            "v", F.least("step", "jump").alias("label"), "old"), "labels")
        labels = moved.select("v", "label")
        if not moved.where("label < old").limit(1).count():
            return labels
