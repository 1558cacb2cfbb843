"""URL filter: rules kept as a sorted digest array in a memory-mapped file.

A rule is a host and a path prefix. It fits its host and all subdomains if the path starts with the
prefix; of several rules that fit, the longest (host and prefix together, then host) decides. The
rules' 64-bit xxhash keys are stored sorted, followed by the places and the bytes of the full rule
strings. The file goes to the shared folder and from there to every executor, which maps it. Per
batch of urls, the keys of all host suffixes and path prefixes (only prefix lengths that occur among
the rules) are looked up by one vectorised binary search; each hit is compared with the stored string,
so colliding keys cannot change a verdict.

A url that no rule fits is allowed. The host is what follows the first ``://`` up to ``/``, ``?``,
``#`` or the end, with A-Z lower-cased; the path goes on to ``?``, ``#`` or the end. A null url or one
without ``://`` has an empty host and path, so no rule fits it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ..sources.storage import fresh_path

MOST_BYTES = 1 << 30  # of an index that is sent to every executor
ALLOW, BLOCK = "allow", "block"
DEFAULT = ALLOW
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def digest(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The index of (host, path prefix, verdict): header, keys, places, prefix lengths, strings.

    Of rules with the same host and prefix, the last one counts.
    """
    verdicts = {}
    for host, path, verdict in rules:
        verdicts[host.encode(), path.encode()] = verdict.encode()
    rows = sorted((xxhash.xxh64_intdigest(h + p), h, p, v) for (h, p), v in verdicts.items())
    blob, places = bytearray(), []
    for _, host, path, verdict in rows:
        places.append((len(blob), len(host), len(path), len(verdict)))
        blob += host + path + verdict
    lengths = sorted({len(p) for _, _, p, _ in rows})
    return (struct.pack("<2q", len(rows), len(lengths)) + np.array([r[0] for r in rows], np.uint64).tobytes()
            + np.array(places, np.int64).tobytes() + np.array(lengths, np.int64).tobytes() + bytes(blob))


class DigestArray:
    """A mapped index and its lookup."""

    def __init__(self, path: str):
        self.raw = np.memmap(path, np.uint8, "r")
        count, widths = struct.unpack("<2q", self.raw[:16].tobytes())
        at = 16
        self.keys = self.raw[at:at + 8 * count].view(np.uint64)
        at += 8 * count
        self.places = self.raw[at:at + 32 * count].view(np.int64).reshape(count, 4)
        at += 32 * count
        self.lengths = self.raw[at:at + 8 * widths].view(np.int64).tolist()
        self.strings = self.raw[at + 8 * widths:]

    def stored(self, place: int) -> tuple[bytes, bytes, str]:
        start, host, path, verdict = map(int, self.places[place])
        text = self.strings[start:start + host + path + verdict].tobytes()
        return text[:host], text[host:host + path], text[host + path:].decode()

    def longest(self, urls: list[tuple[bytes, bytes]]) -> list[tuple[str, str] | None]:
        """The rule string and verdict that decide each (host, path)."""
        keys, owner, asked = [], [], []
        for i, (host, path) in enumerate(urls):
            suffix = host
            while suffix:
                for length in self.lengths:
                    if length > len(path):
                        break
                    keys.append(xxhash.xxh64_intdigest(suffix + path[:length]))
                    owner.append(i)
                    asked.append((suffix, path[:length]))
                suffix = suffix.partition(b".")[2]
        found: list[tuple[str, str] | None] = [None] * len(urls)
        size = [(-1, -1)] * len(urls)
        wanted = np.array(keys, np.uint64)
        first = np.searchsorted(self.keys, wanted)
        for at in np.flatnonzero(first < np.searchsorted(self.keys, wanted, "right")):
            place = int(first[at])
            while place < len(self.keys) and self.keys[place] == wanted[at]:
                host, path, verdict = self.stored(place)
                length = len(host) + len(path), len(host)
                if (host, path) == asked[at] and length > size[owner[at]]:
                    found[owner[at]] = (host + path).decode(), verdict
                    size[owner[at]] = length
                place += 1
        return found


def split(url: str | None) -> tuple[bytes, bytes]:
    """Host and path of a url."""
    _, mark, rest = (url or "").encode().partition(b"://")
    if not mark:
        return b"", b""
    end = min((i for c in b"?#" if (i := rest.find(c)) >= 0), default=len(rest))
    slash = rest.find(b"/", 0, end)
    host = rest[:slash] if slash >= 0 else rest[:end]
    return host.translate(_LOWER), rest[slash:end] if slash >= 0 else b""


def publish(spark: SparkSession, index: bytes) -> str:
    """Put an index into the shared folder and have executors fetch it; returns its name."""
    if len(index) > MOST_BYTES:
        raise ValueError(f"the rules take {len(index)} bytes; an index has at most {MOST_BYTES}")
    path = fresh_path(spark, "urls")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop)
    out.write(bytearray(index))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of (page_id, url)."""
    name = publish(pages.sparkSession, digest(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray(SparkFiles.get(name))
        for batch in batches:
            parts = [split(u) for u in batch.column("url").to_pylist()]
            found = index.longest(parts)
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), pa.array([h.decode() for h, _ in parts], pa.string()),
                pa.array([p.decode() for _, p in parts], pa.string()),
                pa.array([f and f[0] for f in found], pa.string()),
                pa.array([f[1] if f else DEFAULT for f in found], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, verdict string")
