"""Near-duplicate detection by fast similarity sketching.

A document's set is its distinct word shingles. A sketch has a number of places, filled in rounds: in each
of the first rounds every element lands in a hashed place with a hashed value (later rounds rank behind
earlier ones), and from then on in one fixed place per round, so that every place is filled; each place
keeps its minimum. Places agree with the Jaccard similarity as probability and concentrate as if they were
independent. Bands of places are hashed to buckets; ``bands_for`` takes as many as leave two texts that are
just similar enough without a common bucket with a probability of ``MISSED`` at most.

Equal sets are one class from the start (by a 128-bit digest of the sorted set). In each bucket the classes
are compared with one of them, on the words of the whole texts, and linked if ``100 * shared >= percent *
union``. Buckets that still hold several components are split by the places of one or two other bands, in
many ways (``SPLITS``; buckets of a ``FEW`` classes stay whole), and each part's classes are compared with one
that is drawn anew, if they are in another component. That joins most of what belongs together while the comparisons
stay in proportion to the buckets' rows. Then every pair that shares a bucket and is still in two components is
compared, in tiles of ``TILE`` classes a side, as arrays in a task, so no link is left out; links within a component need
no comparison.
Shared shingles are at most the sum of the smaller counts of each of ``BINS`` bins of shingles, which spares most of those
pairs their texts. That last step grows with the square of a bucket where many texts are almost similar enough.
A component's id is its smallest document id.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. With fewer words than the shingle's width
the whole sequence is one shingle; null and empty texts have none and are linked with nothing, nor are
documents without an id. Rows that repeat an id with the same text are one document, rows that repeat it with
another text are documents of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, materialize, mix, packed, raw_texts, shingle_hashes, sliced
from .components import components

WIDTH, PERCENT = 5, 80
MISSED = 5e-7
MOST_ROWS, MOST_BANDS = 7, 64
# How far the one or two other bands lie that split a bucket; (0, 0) leaves it whole.
SPLITS = [(0, 0), (1, 1), (2, 2), (3, 3), (5, 5), (1, 2), (1, 5), (3, 7), (2, 9), (4, 11), (6, 13)]
FEW = 8  # classes in a bucket that is not split
BINS = 256
TILE = 2048  # classes on each side of what one key of the last comparison holds
STRIPE = 128  # classes of one side that are compared with the other side at a time
MOST_ASKED = 1 << 20  # rows of three integers that are broadcast to find their texts
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and places in each, as many places as ``MOST_BANDS`` bands allow."""
    if not 0 < percent <= 100:
        raise ValueError("percent has to be above 0 and at most 100")
    for rows in range(MOST_ROWS, 0, -1):
        bands = math.ceil(math.log(MISSED) / math.log1p(-min(percent / 100, 0.99) ** rows))
        if bands <= MOST_BANDS or rows == 1:
            return bands, rows


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` filled places for each (non-empty) set of 64-bit elements."""
    out = np.full((len(sets), size), EMPTY, np.uint64)
    live = np.arange(len(sets))
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(live, [len(s) for s in sets])
    for turn in range(2 * size):
        seed = mix(np.array([turn + 1], np.uint64))
        hashed = mix(elements ^ seed)
        place = ((hashed >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        if turn >= size:
            place[:] = turn - size
        value = (np.uint64(turn) << np.uint64(32)) | (hashed & np.uint64(0xFFFFFFFF))
        np.minimum.at(out.reshape(-1), owner * size + place, value)
        live = live[(out[live] == EMPTY).any(axis=1)]
        if not len(live):
            break
        wanted = np.zeros(len(sets), bool)
        wanted[live] = True
        elements, owner = elements[wanted[owner]], owner[wanted[owner]]
    return out


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """A bucket key for each band of each sketch."""
    parts = sketch.reshape(len(sketch), bands, sketch.shape[1] // bands)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sketch), bands)).copy()
    for i in range(parts.shape[2]):
        keys = mix(keys + parts[:, :, i] + np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64)


def word_set(hashes: WordHashes, text: bytes, width: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    return np.unique(shingle_hashes(hashes.of(text.lower().split()), width))


def mark(text: str = "text") -> Column:
    return F.xxhash64(text)


def members(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, mark, n_shingles, digest, bands) for every document; without words digest is null."""
    bands, places = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for batch in sliced(whole, "text", 4 << 20):
                sets = [word_set(hashes, t, width) for t in raw_texts(batch.column("text"))]
                found = iter(band_keys(sketches([s for s in sets if len(s)], bands * places), bands))
                none = np.zeros(0, np.int64)
                keys = [next(found) if len(s) else none for s in sets]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(digests, pa.binary()), packed(keys, pa.int64())],
                    ["doc_id", "mark", "n_shingles", "digest", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", mark().alias("mark"), "text").mapInArrow(
        run, f"doc_id {kind}, mark long, n_shingles long, digest binary, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) pairs whose texts are similar enough, compared on whole shingle sets.

    ``texts`` is (id, text).
    """
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, first = WordHashes(), None, None
        for batch in batches:
            keep = []
            for a, one, other in zip(batch.column("a").to_pylist(), raw_texts(batch.column("text_a")),
                                     raw_texts(batch.column("text"))):
                if last != a:
                    last, first = a, word_set(hashes, one, width)
                second = word_set(hashes, other, width)
                shared = len(np.intersect1d(first, second, assume_unique=True))
                keep.append(100 * shared >= percent * (len(first) + len(second) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _classes(rows: DataFrame) -> DataFrame:
    """(id, digest, doc_id, mark, n, bands): each set, with one of its documents."""
    known = rows.where("doc_id is not null and n_shingles > 0")
    sets = materialize(known.groupBy("digest").agg(
        F.min(F.struct("doc_id", "mark")).alias("first"), F.max("n_shingles").alias("n"),
        F.any_value("bands").alias("bands")).select("digest", "first.*", "n", "bands"), "sets")
    for salt in count():  # ids are 64-bit hashes, drawn again if two sets had one
        named = sets.withColumn("id", F.xxhash64("digest", F.lit(salt)))
        if not named.groupBy("id").count().where("count > 1").limit(1).count():
            return named


def _alike(n: Column, other: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(n, other) >= percent * F.greatest(n, other)


def _parts(open_: DataFrame, bands: int) -> DataFrame:
    """(part, id, n, c): the parts of the open buckets of each class (id, n, c, open, large, bands)."""
    def part(i: Column, x: int, y: int) -> Column:
        far = (F.get("bands", (i + k) % bands) for k in (x, y))
        return F.xxhash64(F.get("bands", i), *far, F.lit(x), F.lit(y))

    each = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.when(
        F.array_contains("large", F.get("bands", i)), F.array(*(part(i, x, y) for x, y in SPLITS))).when(
        F.array_contains("open", F.get("bands", i)), F.array(part(i, 0, 0))))
    return open_.select(F.explode(F.flatten(F.array_compact(each))).alias("part"), "id", "n", "c")


def _apart(joined: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, n, c): the buckets' classes with their components."""
    return joined.join(labels, joined["id"] == labels["v"], "left").select(
        "key", "id", "n", F.coalesce("label", "id").alias("c"))


def _mixed(named: DataFrame) -> DataFrame:
    """(key, m): buckets of several components and m classes; a bucket of two has been compared."""
    return named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("m")).where(
        "low < high and m > 2").select("key", "m")


def _binned(texts: DataFrame, width: int) -> DataFrame:
    """(id, bins): how many shingles of each text (id, text) fall in each bin, up to 255."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = (word_set(hashes, t, width) for t in raw_texts(batch.column("text")))
            bins = [np.minimum(np.bincount((s % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()
                    for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bins, pa.binary())], ["id", "bins"])

    return texts.mapInArrow(run, "id long, bins binary")


def _possible(one: np.ndarray, other: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows of bins can be similar enough, given the sums of their sizes."""
    least = np.minimum(one, other)
    most = least.sum(axis=1, dtype=np.int64)
    return (100 * most >= percent * (sizes - most)) | (least == 255).any(axis=1)  # 255 is 255 or more


def _tile(rows: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pairs of one tile's classes that are in two components and can be similar enough."""
    ids, n, c, x, i, j = (rows.column(k).to_numpy() for k in ("id", "n", "c", "x", "i", "j"))
    bins = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
    one, other = np.flatnonzero(x == i), np.flatnonzero(x == j)
    found = [np.zeros((2, 0), np.int64)]
    for at in range(0, len(one), STRIPE):
        part = one[at:at + STRIPE]
        low, high = np.minimum(n[part][:, None], n[other]), np.maximum(n[part][:, None], n[other])
        wanted = (c[part][:, None] != c[other]) & (100 * low >= percent * high)
        if i[0] == j[0]:
            wanted &= part[:, None] < other
        a, b = np.nonzero(wanted)
        for k in range(0, len(a), 1024):
            p, q = part[a[k:k + 1024]], other[b[k:k + 1024]]
            keep = _possible(bins[p], bins[q], n[p] + n[q], percent)
            found.append(ids[np.stack([p[keep], q[keep]])])
    pairs = np.concatenate(found, axis=1)
    return pairs.min(axis=0), pairs.max(axis=0)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each tile (key, i, j), which may lie in several of the sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        names = np.stack([batch.column(k).to_numpy() for k in ("key", "i", "j")], axis=1)
        starts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
        ends = [*starts.tolist(), len(batch)]
        if held and (names[0] != last).any():
            yield pa.concat_batches(held)
            held = []
        at = 0
        for end in ends:
            if at:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            at = end
        last = names[-1]
    if held:
        yield pa.concat_batches(held)


def _crossing(named: DataFrame, bins: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of classes (key, id, n, c) that share a bucket, but no component, and can be similar enough.

    A bucket's classes are dealt to blocks, and every two blocks meet in a tile of their own. Tiles are arrays in a
    task, so that only the pairs that their bins do not rule out become rows.
    """
    mixed = _mixed(named).select("key", F.ceil(F.col("m") / TILE).cast("int").alias("blocks"))
    dealt = named.join(mixed, "key").join(bins, "id").withColumn("x", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = met.select("key", F.least("x", "met").alias("i"), F.greatest("x", "met").alias("j"), "id", "n", "c", "x", "bins")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tiles(batches):
            a, b = _tile(rows, percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, mark, n_shingles, digest), and (digest, component, component_id) of every set."""
    bands, _ = bands_for(percent)
    rows = materialize(members(docs, width, percent), "members")
    classes = _classes(rows)
    buckets = materialize(classes.select("id", "n", F.explode("bands").alias("key")), "buckets")
    leaders = materialize(
        buckets.groupBy("key").agg(F.min(F.struct("id", "n")).alias("lead"), F.max("id").alias("last"))
        .where("lead.id < last").select("key", F.col("lead.id").alias("a"), F.col("lead.n").alias("n_a")), "leaders")
    joined = materialize(buckets.join(leaders, "key"), "joined")  # buckets of two classes or more
    stars = materialize(joined.where((F.col("id") > F.col("a")) & _alike(F.col("n"), F.col("n_a"), percent))
                        .select("a", F.col("id").alias("b")).distinct(), "stars")
    asked = materialize(joined.select("id").distinct().join(classes.select("id", "doc_id", "mark"), "id"), "asked")
    if asked.count() <= MOST_ASKED:  # beyond that both sides are shuffled
        asked = F.broadcast(asked)
    plain = docs.where("doc_id is not null").select("doc_id", mark().alias("mark"), "text")
    texts = materialize(plain.join(asked, ["doc_id", "mark"]).select("id", "text"), "texts")
    links = materialize(confirmed(stars, texts, width, percent), "links")
    labels = components(links)

    named = materialize(_apart(joined, labels), "named")
    split = materialize(_mixed(named).select("key", (F.col("m") > FEW).alias("many")), "split")
    open_ = named.join(split, "key").groupBy("id").agg(
        F.max("n").alias("n"), F.max("c").alias("c"), F.collect_set("key").alias("open"),
        F.collect_set(F.when(F.col("many"), F.col("key"))).alias("large"))
    open_ = materialize(open_.join(classes.select("id", "bands"), "id"), "open")
    parts = _parts(open_, bands)
    drawn = materialize(
        parts.groupBy("part").agg(
            F.min(F.struct(F.xxhash64("id", "part").alias("draw"), F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("c").alias("c_a")))
            .alias("lead"), F.min("c").alias("low"), F.max("c").alias("high"))
        .where("low < high").select("part", "lead.a", "lead.n_a", "lead.c_a"), "drawn")
    met = parts.join(drawn, "part").where((F.col("c") != F.col("c_a")) & _alike(F.col("n"), F.col("n_a"), percent))
    rest = met.select(F.least("id", "a").alias("a"), F.greatest("id", "a").alias("b")).distinct().join(
        stars, ["a", "b"], "left_anti")
    rest = materialize(rest, "rest")
    more = materialize(confirmed(rest, texts, width, percent), "links")
    if more.limit(1).count():
        links = links.union(more)
        labels = components(links)
    apart = materialize(_apart(joined.join(split, "key", "left_semi"), labels), "apart")
    bins = materialize(_binned(texts.join(apart.select("id").distinct(), "id", "left_semi"), width), "bins")
    left = materialize(_crossing(apart, bins, percent).join(stars.union(rest), ["a", "b"], "left_anti"), "crossing")
    more = materialize(confirmed(left, texts, width, percent), "links")
    if more.limit(1).count():
        labels = components(links.union(more))
    named = materialize(classes.join(labels, classes["id"] == labels["v"], "left").select(
        "digest", "doc_id", F.coalesce("label", "id").alias("component")), "named")
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.drop("bands"), materialize(named.drop("doc_id").join(lowest, "component"), "components")


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document row."""
    rows, named = _linked(docs, width, percent)
    return rows.join(named, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, with one of each group: the one with the smallest id.

    Of rows that repeat an id and text, or have one id and texts of one group, one stays; rows that repeat an id
    with texts of several groups stay, one of each. Rows without an id all stay.
    """
    rows, named = _linked(docs, width, percent)
    known = rows.where("doc_id is not null").join(named, "digest", "left")
    first = known.where("component is not null").groupBy("component").agg(
        F.min(F.struct("doc_id", "mark")).alias("first")).select("first.*")
    alone = known.where("component is null").select("doc_id", "mark").distinct()
    stay = materialize(first.union(alone).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")), "stay")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    order = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    marked = docs.select(whole.alias("row"), F.col("doc_id").alias("_id"), mark().alias("_mark"), order.alias("_order"))
    kept = marked.where("_id is not null").join(stay, ["_id", "_mark"], "left_semi")
    single = kept.groupBy("_id", "_mark").agg(F.min_by("row", "_order").alias("row"))
    return single.select("row.*").union(docs.where(F.col("doc_id").isNull()))
