"""Small helpers shared by the operators: text buffers, words, hashing, the held-out fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import materialize  # noqa: F401  (shared with the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """The test fold: crc32 of the id as text, divisible by five. Rows without an id are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; nulls are empty texts."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(starts):
        starts = np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return starts - starts[0], data[starts[0]:starts[-1]]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; nulls are empty texts."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def sliced(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bounded number of distinct words."""

    LIMIT = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; a shorter text is one shingle, no words none."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mix(out + hashes[i:i + n] + np.uint64(0x9E3779B97F4A7C15))
    return out


def packed(lists: list[np.ndarray], value_type: pa.DataType) -> pa.ListArray:
    """An Arrow list column from arrays."""
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.concatenate(lists) if lists else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, value_type))


class Index:
    """Places of integer keys, found for whole arrays at once (open addressing)."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask = size - 1
        self.keys = np.zeros(size, keys.dtype)
        self.place = np.full(size, -1, np.int32)
        waiting = np.arange(len(keys))
        slot = self._first(keys)
        while len(waiting):
            free = np.flatnonzero(self.place[slot] < 0)
            _, pick = np.unique(slot[free], return_index=True)
            done = free[pick]
            self.place[slot[done]] = waiting[done]
            self.keys[slot[done]] = keys[waiting[done]]
            rest = np.ones(len(waiting), bool)
            rest[done] = False
            waiting, slot = waiting[rest], (slot[rest] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32))
                & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those not held."""
        slot = self._first(keys)
        out = self.place[slot]
        pending = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(pending):
            slot[pending] = (slot[pending] + 1) & self.mask
            at = slot[pending]
            out[pending] = self.place[at]
            pending = pending[(out[pending] >= 0) & (self.keys[at] != keys[pending])]
        return out
