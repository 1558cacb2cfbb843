"""Language-model scores by stupid backoff over word n-grams that stand in other documents.

The documents are written once in blocks. Each block's n-grams of words, orders one to three, are counted
and sent, in chunks sorted by key, to the part of the count table that holds their range of keys. A part
adds up its chunks, which cover every document and leave out no n-gram, and answers each block with the
counts in the order of the block's keys. The block scores every word and sums per document:

    S(w | context) = count(context w) / count(context)        if the n-gram stands in another document
                     alpha * S(w | context without its first word)   otherwise

with ``(count(w) + 1) / (words + 1)`` for single words. All counts are those in the whole corpus less the
document's own: otherwise an n-gram that stands nowhere else, whose context is as rare, would be certain.

Words are what ASCII white space separates, as they are. A key is 80 bits of hash, so that 10^10 distinct
n-grams hold a pair of equal keys with a probability of 4e-5; within a block n-grams are told apart
exactly. Rows are chunks, one per block and part, so a frequent n-gram gathers one entry per block.

A document's score is the mean of the natural logarithm over its words; a text without words, or null,
has n_words 0 and score null. Copies under other rows count as other documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, mix, raw_texts, sliced
from .ngrams import ALPHA, SLICE, blocks

ORDER = 3
BLOCK_BYTES = 8 << 20
PART_BYTES = 4 << 20  # text whose n-grams make up a part of the count table, about
STEP = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Ids(dict):
    """Numbers of words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _words(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in each text, the number of each word, and the two hashes of each number."""
    ids, parts = _Ids(), []
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        for text in raw_texts(chunk):
            words = text.split()
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
    digests = b"".join(map(xxhash.xxh3_128_digest, ids))
    return (np.array([len(p) for p in parts], np.int64), np.concatenate([np.zeros(0, np.int64), *parts]),
            np.frombuffer(digests, np.uint64).reshape(-1, 2))


class Block:
    """The distinct n-grams of a block's texts, in the order of their keys."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, order: int):
        self.sizes, ids, hashes = _words(texts)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(ids)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        number, keys, self.at = ids, mix(hashes), []
        all_keys, counts, base = [], [], 0
        for n in range(1, order + 1):
            if n > 1:
                ends = np.flatnonzero(self.place >= n - 1)
                distinct, inverse = np.unique(number[ends - 1] << 32 | ids[ends], return_inverse=True)
                keys = mix(mix(keys[distinct >> 32] + STEP) ^ hashes[distinct & 0xFFFFFFFF])
                number = np.full(len(ids), -1)
                number[ends] = inverse
            all_keys.append(keys)
            counts.append(np.bincount(number[number >= 0], minlength=len(keys)))
            self.at.append(np.where(number >= 0, number + base, -1))  # of each word, the n-gram it ends
            base += len(keys)
        keys = np.concatenate(all_keys)
        del all_keys
        order_ = _order(keys[:, 0], keys[:, 1].astype(np.uint16))
        self.high, self.low = keys[order_, 0], keys[order_, 1].astype(np.uint16)
        self.count = np.concatenate(counts)[order_]
        rank = np.empty(len(order_) + 1, np.int64)
        rank[order_], rank[-1] = np.arange(len(order_)), -1
        self.at = [rank[at] for at in self.at]


def _order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What sorts keys."""
    order = np.argsort(high, kind="stable")
    sorted_ = high[order]
    return np.lexsort((low, high)) if (sorted_[1:] == sorted_[:-1]).any() else order


def _packed(values: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes; leading bytes of sorted keys and of counts repeat."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(),
                       "zstd", asbytes=True)


def _unpacked(data: bytes, size: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, size * width, "zstd"), np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _extent(blocked: DataFrame) -> tuple[int, int]:
    """Words and bytes of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = size = 0
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                starts, data = buffers(batch.column("text"))
                space = SPACE[data]
                before = np.concatenate([[True], space[:-1]])[:len(space)]
                before[starts[:-1][np.diff(starts) > 0]] = True
                words += int((before & ~space).sum())
                size += len(data)
        yield pa.RecordBatch.from_arrays([pa.array([words]), pa.array([size])], ["words", "size"])

    row = blocked.select("text").mapInArrow(run, "words long, size long").agg(F.sum("words"), F.sum("size")).first()
    return row[0] or 0, row[1] or 0


def _chunks(blocked: DataFrame, order: int, parts: int) -> DataFrame:
    """(part, block, size, high, low, n): the n-grams of each block that belong to a part.

    A block that two tasks read gives a row for each of them.
    """
    def settled(block: int, texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        found = Block(pa.chunked_array(texts), order)
        part = ((found.high >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(part)]
        for a, z in zip(edges, edges[1:]):
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([int(part[a])], pa.int32()), "block": pa.array([block], pa.int64()),
                "size": pa.array([z - a], pa.int32()), "high": [_packed(found.high[a:z])],
                "low": [_packed(found.low[a:z])], "n": [_packed(found.count[a:z])]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            for block in batch.column("block").unique().to_pylist():
                if block != current and held:
                    yield from settled(current, held)
                    held = []
                current = block
                held.append(batch.filter(pc.equal(batch.column("block"), block)).column("text"))
        if held:
            yield from settled(current, held)

    return blocked.select("block", "text").mapInArrow(
        run, "part int, block long, size int, high binary, low binary, n binary")


def _bundles(blocked: DataFrame) -> DataFrame:
    """(block, bundle): ids and texts, compressed, as they are moved once more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for block in whole.column("block").unique().to_pylist():
                rows = whole.filter(pc.equal(whole.column("block"), block)).select(["doc_id", "text"])
                for batch in sliced(rows, "text", SLICE):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(batch)
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()),
                                                      "bundle": [sink.getvalue().to_pybytes()]})

    return blocked.mapInArrow(run, "block long, bundle binary")


def _answers(chunks: DataFrame) -> DataFrame:
    """(block, part, size, count): the corpus counts of each block's n-grams, in the order of their keys."""
    def run(table: pa.Table) -> pa.Table:
        sizes, blocks_ = table.column("size").to_pylist(), table.column("block").to_pylist()
        high, low, n = (np.concatenate([_unpacked(x, s, kind) for x, s in zip(table.column(name).to_pylist(), sizes)])
                        for name, kind in (("high", np.uint64), ("low", np.uint16), ("n", np.int64)))
        order = _order(high, low)
        high, low = high[order], low[order]
        fresh = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        totals = np.add.reduceat(n[order], np.flatnonzero(fresh))
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        grams: dict[int, list] = {}
        for block, end, size in zip(blocks_, np.cumsum(sizes), sizes):
            grams.setdefault(block, []).append(number[end - size:end])
        counts = [totals[g[0] if len(g) == 1 else np.unique(np.concatenate(g))] for g in grams.values()]
        return pa.table({
            "block": pa.array(list(grams), pa.int64()),
            "part": pa.array([table.column("part")[0].as_py()] * len(grams), pa.int32()),
            "size": pa.array([len(c) for c in counts], pa.int32()), "count": pa.array(map(_packed, counts), pa.binary())})

    return chunks.groupBy("part").applyInArrow(run, "block long, part int, size int, count binary")


def _sums(block: Block, counts: np.ndarray, total: int, alpha: float) -> np.ndarray:
    """Sum of the logarithms of each text's words."""
    logs = np.zeros(len(block.row))
    waiting = np.ones(len(logs), bool)
    elsewhere = [_elsewhere(block, at, counts) for at in block.at]
    for n in range(len(block.at), 0, -1):
        of = np.flatnonzero(waiting & (block.place >= n - 1) & ((n == 1) | (elsewhere[n - 1] > 0)))
        if n > 1:
            logs[of] += np.log(elsewhere[n - 1][of] / elsewhere[n - 2][of - 1])
        else:
            logs[of] += np.log((elsewhere[0][of] + 1) / (total - block.sizes[block.row[of]] + 1))
        waiting[of] = False
        logs[waiting & (block.place >= n - 1)] += np.log(alpha)
    return np.bincount(block.row, logs, len(block.sizes))


def _elsewhere(block: Block, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often the n-gram that each word ends stands in other texts; 0 where there is none."""
    out = np.zeros(len(at), np.int64)
    ends = np.flatnonzero(at >= 0)
    _, inverse, own = np.unique(block.row[ends] << 32 | at[ends], return_inverse=True, return_counts=True)
    out[ends] = counts[at[ends]] - own[inverse]
    return out


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_words, score) for every document, scored against counts of all others."""
    blocked = blocks(docs, BLOCK_BYTES)
    total, size = _extent(blocked)
    answers = _answers(_chunks(blocked, order, max(1, -(-size // PART_BYTES))))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(bundles: pa.Table, table: pa.Table) -> pa.Table:
        texts = pa.concat_tables(pa.ipc.open_stream(b).read_all() for b in bundles.column("bundle").to_pylist())
        block = Block(texts.column("text"), order)
        table = table.sort_by("part")
        counts = np.concatenate([np.zeros(0, np.int64), *(
            _unpacked(x, n, np.int64) for x, n in zip(table.column("count").to_pylist(), table.column("size").to_pylist()))])
        if len(counts) != len(block.high):
            raise ValueError("the counts of a block do not fit its n-grams")
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": block.sizes,
                         "sum": _sums(block, counts, total, alpha)})

    found = (_bundles(blocked).groupBy("block").cogroup(answers.groupBy("block"))
             .applyInArrow(run, f"doc_id {kind}, n_words long, sum double"))
    return found.select("doc_id", "n_words",
                        F.when(F.col("n_words") > 0, F.col("sum") / F.col("n_words")).alias("score"))
