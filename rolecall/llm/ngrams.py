"""Language-model scores by stupid backoff over byte n-grams, computed with joins.

The corpus is written once in blocks of about ``BLOCK_BYTES`` of text. Each block's n-grams, orders one
to five, are exploded with their counts; Spark adds them up into one count table, partitioned by the
hash of the n-gram, that covers every document. An n-gram of order two or more is in the table if it
occurs at least ``min_count`` times. The exploded n-grams of each block are joined to the table, and
the counts go back to their block, where every byte is scored and summed per document:

    S(c | context) = count(context c) / count(context)        if the n-gram is in the table
                     alpha * S(c | context without its first byte)   otherwise

with ``count(c) / N`` for single bytes. An n-gram is an integer of up to five bytes, so equal keys mean
equal n-grams. A third of all documents may be copies: they only repeat keys within blocks, and block
sizes are bounded in bytes, so no key gathers rows. A document larger than a block is its own block.

A document's score is the mean of the natural logarithm over its bytes; a null or empty text has
n_bytes 0 and score null. Contexts do not reach across documents; the first bytes of a text have the
shorter contexts that exist.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import fresh_path
from .common import Index, buffers, materialize, sliced

ORDER = 5
ALPHA = 0.4
MIN_COUNT = 2
BLOCK_BYTES = 32 << 20
SLICE = 2 << 20  # bytes of text that are counted or scored in one go


def _grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each byte, its place in the text, and the bytes up to it as one integer."""
    starts, data = buffers(texts)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts))
    place = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
    gram = data.astype(np.int64)
    for back in range(1, order):
        gram[back:] |= data[:-back].astype(np.int64) << 8 * back
    return row, place, gram


def _mask(n: int) -> int:
    return (1 << 8 * n) - 1


def _tallied(texts: pa.Array, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Order, n-grams and counts. A shorter n-gram ends a longer one, or starts its text."""
    _, place, gram = _grams(texts, order)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for n in range(order, 0, -1):
        fresh = gram[place >= n - 1] if n == order else gram[place == n - 1] & _mask(n)
        fresh, more = np.unique(fresh, return_counts=True)
        keys, inverse = np.unique(np.concatenate([keys & _mask(n), fresh]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([counts, more]), len(keys)).astype(np.int64)
        yield n, keys, counts


def blocks(docs: DataFrame, most: int | None = None) -> DataFrame:
    """Write (block, doc_id, text) once, blocks bounded in bytes (``BLOCK_BYTES`` unless given)."""
    most = most or BLOCK_BYTES
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            for batch in sliced(whole, "text", most):
                size = int(buffers(batch.column("text"))[0][-1])
                if held + size > most and held:
                    block, held = block + 1, 0
                held += size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, block)), *batch.columns],
                    ["block", *batch.schema.names])

    path = fresh_path(docs.sparkSession, "blocks")
    schema = f"block long, doc_id {kind}, text string"
    docs.select("doc_id", "text").mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def exploded(blocked: DataFrame, order: int = ORDER) -> DataFrame:
    """(block, order, gram, n): how often each n-gram occurs in each block.

    A block that two tasks read gives a row for each of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        current = None

        def settled() -> Iterator[pa.RecordBatch]:
            for n in sorted(held):
                keys, counts = _added(held[n])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), current)), pa.array(np.full(len(keys), n, np.int32)),
                     pa.array(keys), pa.array(counts)], ["block", "order", "gram", "n"])
            held.clear()

        for whole in batches:
            blocks = whole.column("block")
            for block in blocks.unique().to_pylist():
                if block != current:
                    yield from settled()
                    current = block
                for batch in sliced(whole.filter(pc.equal(blocks, block)), "text", SLICE):
                    for n, keys, counts in _tallied(batch.column("text"), order):
                        held.setdefault(n, []).append((keys, counts))
                        if len(held[n]) > 4:
                            held[n] = [_added(held[n])]
        yield from settled()

    return blocked.select("block", "text").mapInArrow(run, "block long, order int, gram long, n long")


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several tallies together."""
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys))
    return keys, counts.astype(np.int64)


def count_table(grams: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(order, gram, count) over the whole corpus."""
    counts = grams.groupBy("order", "gram").agg(F.sum("n").alias("count"))
    return counts.where((F.col("order") == 1) | (F.col("count") >= min_count))


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA,
          min_count: int = MIN_COUNT) -> DataFrame:
    """(doc_id, n_bytes, score) for every document, scored against counts of all of them."""
    blocked = blocks(docs)
    grams = materialize(exploded(blocked, order), "grams")
    counts = count_table(grams, min_count)
    total = grams.where("order = 1").agg(F.sum("n")).first()[0] or 0
    joined = grams.select("block", "order", "gram").join(counts, ["order", "gram"])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(texts: pa.Table, table: pa.Table) -> pa.Table:
        levels = _levels(table, order, total)
        parts = [pa.table({"doc_id": pa.array([], texts.schema.field("doc_id").type),
                           "n_bytes": pa.array([], pa.int64()), "sum": pa.array([], pa.float64())})]
        for whole in texts.select(["doc_id", "text"]).to_batches():
            for batch in sliced(whole, "text", SLICE):
                logs, row = _logs(batch.column("text"), levels, alpha)
                parts.append(pa.table({
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": np.bincount(row, minlength=batch.num_rows).astype(np.int64),
                    "sum": np.bincount(row, logs, batch.num_rows)}))
        return pa.concat_tables(parts)

    found = (blocked.groupBy("block").cogroup(joined.groupBy("block"))
             .applyInArrow(run, f"doc_id {kind}, n_bytes long, sum double"))
    return found.select("doc_id", "n_bytes",
                        F.when(F.col("n_bytes") > 0, F.col("sum") / F.col("n_bytes")).alias("score"))


def _levels(table: pa.Table, order: int, total: int) -> list[tuple[Index, np.ndarray]]:
    """Per order, the n-grams of the table and the logarithm of count / count of the context."""
    levels, below, counted = [], np.zeros(1, np.int64), np.array([float(total)])
    for n in range(1, order + 1):
        rows = table.filter(pc.equal(table.column("order"), n))
        keys, first = np.unique(rows.column("gram").to_numpy(), return_index=True)
        counts = rows.column("count").to_numpy()[first].astype(np.float64)
        at = np.searchsorted(below, keys >> 8)
        levels.append((Index(keys), np.log(counts / counted[at])))
        below, counted = keys, counts
    return levels


def _logs(texts: pa.Array, levels: list, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Log score of every byte of the texts, and its row."""
    order = len(levels)
    row, place, gram = _grams(texts, order)
    logs = np.zeros(len(row))
    waiting, starts = np.flatnonzero(place >= order - 1), np.flatnonzero(place < order - 1)
    for n in range(order, 0, -1):
        index, value = levels[n - 1]
        waiting = np.concatenate([waiting, starts[place[starts] == n - 1]]) if n < order else waiting
        found = index.find(gram[waiting] & _mask(n))
        hit = found >= 0
        logs[waiting[hit]] += value[found[hit]]
        waiting = waiting[~hit]
        logs[waiting] += np.log(alpha)
    return logs, row
