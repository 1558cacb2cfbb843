"""Exact top-k search by inner product: distributed histogram selection.

Every query is scored against every candidate, in blocks, several times; scores are never stored.
Each round counts scores into a histogram per query over the range that still holds its kth score
(at first the range that the Cauchy-Schwarz bound leaves), adds the histograms up across tasks and
keeps the one bin with the kth score, until a bin is one integer wide. A last round returns what
scores higher than the kth score, and of what ties with it each task's k smallest ids, which is
enough; ranks are by score, then id.

Components become ``floor(1024 * x)``. Vectors that are null, empty, or hold null or non-finite
components take no part; vectors of different lengths are never compared. A query is not its own
candidate (rows with its id are left out); with fewer than k candidates all are returned. Vectors
with components beyond 2**26 are scored with exact Python integers and cut to the range of a long.

Blocks of candidates meet blocks of queries by a join on (dimension, query block, lane). Lanes spread
the candidates of one query block over tasks, and every lane has its own copy of the query block, so
no task holds more than one block of each side at a time. There are no more lanes than candidate blocks, and
blocks are shuffled, never broadcast, as a broadcast would pass all copies through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 1024  # rows in a block of either side
BINS = 1024
EXACT = 1 << 26
LONG = (1 << 63) - 1


def _whole(vector: np.ndarray | None) -> np.ndarray | None:
    """Integer components, or None for a vector that takes no part."""
    if vector is None or not len(vector):
        return None
    values = np.asarray(vector, np.float64)
    return np.floor(values * 1024) if np.isfinite(values).all() else None


def blocks(vectors: DataFrame) -> DataFrame:
    """Pack (vec_id, embedding) rows into blocks: (dim, ids, data, norm, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            data = np.array([v for _, v in rows])
            norm = float(np.sqrt((data ** 2).sum(axis=1)).max())
            return pa.RecordBatch.from_arrays(
                [pa.array([dim]), pa.array([np.array([i for i, _ in rows], np.int64).tobytes()]),
                 pa.array([data.tobytes()]), pa.array([norm]), pa.array([len(rows)])],
                ["dim", "ids", "data", "norm", "n"])

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if vec_id is None or vector is None or None in vector:
                    continue
                whole = _whole(vector)
                if whole is None:
                    continue
                held.setdefault(len(whole), []).append((vec_id, whole))
                if len(held[len(whole)]) == BLOCK:
                    yield flush(len(whole))
        for dim in list(held):
            yield flush(dim)

    return vectors.select("vec_id", "embedding").mapInArrow(
        run, "dim long, ids binary, data binary, norm double, n long")


def _unpacked(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, np.int64)
    return keys, np.frombuffer(data, np.float64).reshape(len(keys), -1)


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products as int64."""
    peak = max(np.abs(queries).max(), np.abs(candidates).max())
    if peak ** 2 * queries.shape[1] < 2.0 ** 53:
        return (queries @ candidates.T).astype(np.int64)
    exact = [[int(x) for x in row] for row in candidates]
    return np.array([
        [min(max(sum(a * b for a, b in zip(q, c)), -LONG), LONG) for c in exact]
        for q in ([int(x) for x in row] for row in queries)], np.int64)


def _scored(pairs: DataFrame, use: Callable, schema: str) -> DataFrame:
    """Apply ``use(row, query ids, ids, scores, pairs to leave out)`` to every pair of blocks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                ids, data = _unpacked(row.ids, row.data)
                q_ids, q_data = _unpacked(row.q_ids, row.q_data)
                yield use(row, q_ids, ids, scores(q_data, data), q_ids[:, None] == ids[None, :])

    return pairs.mapInPandas(run, schema)


def _counter(width: int, wide: bool) -> Callable:
    """Counts of scores per query and bin; all above the range fall into the last bin."""
    def use(row, q_ids, ids, matrix, own) -> pd.DataFrame:
        low = np.array(row.low)[:, None]
        gap = matrix.astype(object) - low.astype(object) if wide else matrix - low
        bins = np.clip(gap // width, -1, BINS).astype(np.int64)
        q, c = np.nonzero((bins >= 0) & ~own)
        keys, counts = np.unique(q * (BINS + 1) + bins[q, c], return_counts=True)
        return pd.DataFrame({"block": row.block, "q": keys // (BINS + 1),
                             "bin": keys % (BINS + 1), "n": counts})
    return use


def _taker(k: int) -> Callable:
    """Scores above each query's kth score, and the k smallest ids among the ties."""
    def use(row, q_ids, ids, matrix, own) -> pd.DataFrame:
        low = np.array(row.low)[:, None]
        order = np.argsort(ids, kind="stable")
        matrix, own, ids = matrix[:, order], own[:, order], ids[order]
        tied = (matrix == low) & ~own
        q, c = np.nonzero(((matrix > low) & ~own) | (tied & (tied.cumsum(axis=1) <= k)))
        return pd.DataFrame({"query_id": q_ids[q], "vec_id": ids[c], "score": matrix[q, c]})
    return use


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` for each of ``queries``.

    Both are (vec_id, embedding).
    """
    spark = vectors.sparkSession
    candidates = materialize(blocks(vectors), "candidates")
    asked = materialize(
        blocks(queries).withColumn("block", F.monotonically_increasing_id()), "queries")
    peaks = candidates.groupBy("dim").agg(F.max("norm").alias("peak"))  # one row a dimension
    bound = asked.join(F.broadcast(peaks), "dim").agg(
        F.max(F.col("norm") * F.col("peak"))).first()[0] or 0.0
    bound = min(int(bound * (1 + 1e-9)) + 1, LONG)
    lanes = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), candidates.count()))
    spread = candidates.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes))).join(
        F.broadcast(asked.select("dim", "block")), "dim").select("block", "lane", "ids", "data")  # a row per query block
    each = asked.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("q"))
    lows = materialize(each.withColumn("low", F.lit(-bound)), "lows")

    def pairs() -> DataFrame:
        """Blocks of candidates with blocks of queries and where each query's range starts."""
        packed = lows.groupBy("block").agg(
            F.array_sort(F.collect_list(F.struct("q", "low"))).getField("low").alias("low"))
        copies = asked.join(packed.hint("merge"), "block").select(
            "block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "low",
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"))
        return spread.join(copies.hint("merge"), ["block", "lane"])

    whole = lambda c: c.cast("decimal(19,0)")  # noqa: E731  the product may leave the range of a long
    width = -(-(2 * bound + 1) // BINS)
    while True:
        counted = _scored(pairs(), _counter(width, bound > LONG >> 2),
                          "block long, q long, bin long, n long")
        counted = counted.groupBy("block", "q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("block", "q").orderBy(F.desc("bin"))
        kth = (counted.withColumn("above", F.sum("n").over(down)).where(F.col("above") >= k)
               .groupBy("block", "q").agg(F.max("bin").alias("bin")))
        lows = materialize(
            lows.join(kth.hint("merge"), ["block", "q"], "left").select(
                "block", "q", (whole(F.col("low")) + whole(F.coalesce("bin", F.lit(0))) * whole(F.lit(width)))
                .cast("long").alias("low")), "lows")
        if width == 1:
            break
        width = -(-width // BINS)
    found = _scored(pairs(), _taker(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", place).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
