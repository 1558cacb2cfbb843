"""Row numbers over a whole ordered table, or within keys, without one-task windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import spool

_PART_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def sequenced(df: DataFrame, order: list[Column], name: str = "seq") -> DataFrame:
    """Range-sort ``df`` and store an order-preserving (not dense) long with every row.

    The result is written out, so the numbers are the same however often it is read.
    """
    return spool(
        df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), "sequenced")


def slice_of(seq: Column) -> Column:
    """The sort partition a sequence number came from: a bounded slice of any group."""
    return F.shiftright(seq, _PART_BITS)


def row_numbers(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Dense 1-based row number over the whole ordered table.

    The rows are written before the sort, which would otherwise compute them twice: once to
    sample its ranges, once to sort. Each sort partition is then numbered on its own; the
    offsets are one row per partition, which bounds the window over them and the broadcast.
    """
    rows = sequenced(spool(df, "unsorted"), order, "_seq").withColumn(
        "_slice", slice_of("_seq"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_slice").count().select(
        "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    in_slice = F.col("_seq").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    return (
        rows.join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_before") + in_slice + 1)
        .drop("_slice", "_before", "_seq")
    )


def running_counts(df: DataFrame, key: str, seq: str, counted: dict[str, str]) -> DataFrame:
    """Running counts of SQL conditions within ``key`` by ``seq``, for keys of any size.

    ``seq`` must come from ``sequenced`` (or be stored by it). A key is counted slice by slice;
    only one row per key and slice goes through the window that adds the slices up.
    """
    sliced = df.withColumn("_slice", slice_of(seq))
    within = f"OVER (PARTITION BY {key}, _slice ORDER BY {seq})"
    earlier = (f"OVER (PARTITION BY {key} ORDER BY _slice "
               "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    totals = sliced.groupBy(key, "_slice").agg(
        *[F.expr(f"count_if({condition}) AS {name}") for name, condition in counted.items()])
    offsets = totals.selectExpr(
        key, "_slice",
        *[f"coalesce(sum({name}) {earlier}, 0) AS _{name}_before" for name in counted])
    inner = sliced.selectExpr(
        "*", *[f"count_if({condition}) {within} AS {name}" for name, condition in counted.items()])
    return inner.join(offsets, [key, "_slice"]).selectExpr(
        *[f"`{c}`" for c in df.columns],
        *[f"{name} + _{name}_before AS {name}" for name in counted])
