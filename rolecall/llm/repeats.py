"""Substring deduplication with prefix-partitioned suffix trees.

A window is ``DEPTH`` consecutive words of one document. A word goes if a window that covers it also
starts in a document with a smaller id. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.

Suffixes are split by variable-length prefixes. Each window is read from its *anchor*, the place whose
run of ``PREFIX`` words has the smallest hash in the window (the first on a tie); equal windows have
equal anchors, and one anchor serves a run of neighbouring windows. Anchors whose prefix occurs in one
document only are dropped by an aggregation over prefixes. For the others, the words around the anchor
are sent to the prefix's group, where two trees grow word by word: one of the suffixes right of the
anchors, one of the reversed texts left of them. An internal node's members share its path, so a window
that lies ``o`` words left and ``DEPTH - o`` right of its anchor repeats wherever both deep nodes are the
same; the smallest document of such a pair keeps it. Nodes compare words themselves, not hashes.

A group with more than ``MOST`` anchors (a passage that a large part of the corpus shares) is split by
longer prefixes, up to all the words: runs of its windows, and single windows where a run does not
repeat, become keys of their own, and minima combine before the shuffle. So no task holds a group larger
than ``MOST`` anchors, and no window is left out.

Documents with equal texts are grown once: all but the one with the smallest id lose every word (if
there are ``DEPTH`` at least). Null and empty texts have no words; documents without an id keep all
their words and take none from others; rows that repeat an id and text are treated alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, materialize, raw_texts, shingle_hashes, sliced

DEPTH, PREFIX = 50, 8
REACH = DEPTH - PREFIX  # furthest an anchor lies from the start of its window
MOST = 500  # anchors in a group
RUN = 8  # windows that are looked up at once in large groups
TOGETHER = 20_000  # anchors whose trees are grown in one go


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Prefix hash, place, first and last window start of each anchor of a text."""
    prefixes = shingle_hashes(hashes, PREFIX)
    view = sliding_window_view(prefixes, REACH + 1)
    place = view.argmin(axis=1) + np.arange(len(view))
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], len(place)) - 1
    return prefixes[place[first]].view(np.int64), place[first], first, last


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for whole in batches:
        for batch in sliced(whole, "text"):
            row, parts = [], []
            for i, text in enumerate(raw_texts(batch.column("text"))):
                words = text.split()
                if len(words) >= DEPTH:
                    parts.append(anchors(hashes.of(words)))
                    row.append(np.full(len(parts[-1][0]), i))
            if not parts:
                continue
            taken = batch.select(["doc_id", "mark"]).take(pa.array(np.concatenate(row)))
            values = [pa.array(np.concatenate(x)) for x in zip(*parts)]
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, values[0], *(v.cast(pa.int32()) for v in values[1:])],
                ["doc_id", "mark", "prefix", "place", "first", "last"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words around each wanted anchor: its windows, and no more."""
    for whole in batches:
        for batch in sliced(whole, "text"):
            columns: list[list] = [[] for _ in range(8)]
            for doc, mark, text, wanted in zip(
                    batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(),
                    raw_texts(batch.column("text")), batch.column("wanted").to_pylist()):
                words = text.split()
                for w in wanted:
                    around = b" ".join(words[w["first"]:w["last"] + DEPTH])
                    for column, value in zip(columns, (doc, mark, w["prefix"], w["place"], w["first"],
                                                       w["last"], around, w["large"])):
                        column.append(value)
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int32(), pa.int32(),
                     pa.int32(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "mark", "prefix", "place", "first", "last", "words", "large"])


def _refined(nodes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Children of tree nodes by the next word, numbered from 0."""
    key = nodes.astype(np.int64) * (int(words.max()) + 2) + words + 1
    return np.unique(key, return_inverse=True)[1]


def repeated(docs: np.ndarray, group: np.ndarray, place: np.ndarray, first: np.ndarray,
             last: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, window start) of the windows that also start in a smaller document of the row's group."""
    known: dict[bytes, int] = {}
    rows = [np.fromiter((known.setdefault(w, len(known)) for w in t.split()), np.int64) for t in texts]
    n = len(rows)
    right, left = np.full((DEPTH, n), -1), np.full((REACH, n), -1)
    for i, (row, at) in enumerate(zip(rows, place - first)):
        after, before = row[at:at + DEPTH], row[:at][::-1][:REACH]
        right[:len(after), i], left[:len(before), i] = after, before
    nodes = np.unique(group, return_inverse=True)[1]
    deep = {0: nodes}
    for depth in range(DEPTH):
        nodes = deep[depth + 1] = _refined(nodes, right[depth])
    found_rows, found_starts = [], []
    back = np.zeros(n, np.int64)
    for offset in range(REACH + 1):
        if offset:
            back = _refined(back, left[offset - 1])
        start = place - offset
        served = np.flatnonzero((start >= first) & (start <= last))
        if not len(served):
            continue
        both = deep[DEPTH - offset][served] * n + back[served]
        ids, inverse = np.unique(both, return_inverse=True)
        smallest = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(smallest, inverse, docs[served])
        again = served[smallest[inverse] < docs[served]]
        found_rows.append(again)
        found_starts.append(start[again])
    return np.concatenate(found_rows), np.concatenate(found_starts)


def _spans(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first and end word of each run of neighbouring windows."""
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    fresh = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(starts, prepend=-9) > 1))
    ends = starts[np.append(fresh[1:], len(starts)) - 1] + DEPTH
    return rows[fresh], starts[fresh], ends


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans of anchors that come sorted by prefix."""
    def settle(table: pa.Table) -> pa.RecordBatch:
        number = {c: table.column(c).to_numpy() for c in ("doc_id", "prefix", "place", "first", "last")}
        rows, starts = repeated(
            number["doc_id"], number["prefix"], number["place"].astype(np.int64),
            number["first"].astype(np.int64), number["last"].astype(np.int64),
            table.column("words").to_pylist())
        rows, starts, ends = _spans(rows, starts)
        taken = table.select(["doc_id", "mark"]).take(pa.array(rows)).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [*(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in taken.columns),
             pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "mark", "start", "end"])

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < TOGETHER:
            continue
        table = pa.Table.from_batches(held)
        prefix = table.column("prefix").to_numpy()
        whole = int(np.searchsorted(prefix, prefix[-1]))  # the last prefix may go on
        if whole:
            yield settle(table.slice(0, whole))
            held = table.slice(whole).to_batches()
            count = table.num_rows - whole
    if count:
        yield settle(pa.Table.from_batches(held))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the anchors in runs of up to ``RUN``: a key of all the run's words, one per window."""
    for batch in batches:
        row, starts, keys, windows = [], [], [], []
        for i, (place, first, last, text) in enumerate(zip(*(
                batch.column(c).to_pylist() for c in ("place", "first", "last", "words")))):
            words = text.split()
            start = first
            while start <= last:
                # Runs end at fixed distances from the anchor, so equal passages have equal runs.
                stop = min(last, place - (place - start) // RUN * RUN)
                row.append(i)
                starts.append(start)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words[start - first:stop - first + DEPTH])))
                windows.append([xxhash.xxh3_128_digest(b" ".join(words[k:k + DEPTH]))
                                for k in range(start - first, stop - first + 1)])
                start = stop + 1
        taken = batch.select(["doc_id", "mark"]).take(pa.array(row, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*taken.columns, pa.array(starts, pa.int32()), pa.array(keys, pa.binary()),
             pa.array(windows, pa.list_(pa.binary()))], ["doc_id", "mark", "start", "run", "windows"])


def _long_prefixes(around: DataFrame) -> DataFrame:
    """Repeated spans of the anchors of large groups, by their whole words.

    A run of windows that a smaller document has goes at once. Of the other runs (the first of their
    kind, and those at the edges of a passage) every window is looked up; the smallest document with a
    window is always among them.
    """
    runs = materialize(around.select("doc_id", "mark", "place", "first", "last", "words").mapInArrow(
        _runs, "doc_id long, mark long, start int, run binary, windows array<binary>"), "runs")
    low = materialize(runs.groupBy("run").agg(F.min("doc_id").alias("low")), "low")
    judged = materialize(runs.join(low, "run").select(
        "doc_id", "mark", "start", "windows", (F.col("low") < F.col("doc_id")).alias("again")), "judged")
    whole = judged.where("again").select(
        "doc_id", "mark", "start", (F.col("start") + F.size("windows") + (DEPTH - 1)).alias("end"))
    single = materialize(judged.where("not again").select(
        "doc_id", "mark", "start", F.posexplode("windows").alias("k", "window"))
        .select("doc_id", "mark", (F.col("start") + F.col("k")).alias("start"), "window"), "windows")
    smallest = materialize(single.groupBy("window").agg(F.min("doc_id").alias("low")), "low")
    edges = single.join(smallest, "window").where("low < doc_id").select(
        "doc_id", "mark", "start", (F.col("start") + DEPTH).alias("end"))
    return whole.union(edges)


def spans(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, mark, start, end): runs of words to remove from documents that are not copies.

    ``docs`` has (doc_id long, mark long, text), one row a document and text, without null ids.
    """
    found = materialize(docs.mapInArrow(
        _anchored, "doc_id long, mark long, prefix long, place int, first int, last int"), "anchors")
    shared = materialize(
        found.groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                                    F.count(F.lit(1)).alias("n"))
        .where("low < high").select("prefix", (F.col("n") > most).alias("large")), "prefixes")
    wanted = found.join(shared, "prefix").groupBy("doc_id", "mark").agg(
        F.collect_list(F.struct("prefix", "place", "first", "last", "large")).alias("wanted"))
    around = materialize(docs.join(wanted, ["doc_id", "mark"]).mapInArrow(
        _cut, "doc_id long, mark long, prefix long, place int, first int, last int, words binary, "
        "large boolean"), "around")
    grown = (around.where("not large").drop("large").repartition("prefix").sortWithinPartitions("prefix")
             .mapInArrow(_grown, "doc_id long, mark long, start int, end int"))
    return grown.union(_long_prefixes(around.where("large")))


def _removed(words: int, runs: list) -> np.ndarray:
    """Which words go."""
    edge = np.zeros(words + 1, np.int32)
    for run in runs or ():
        edge[min(run["start"], words)] += 1
        edge[min(run["end"], words)] -= 1
    return np.cumsum(edge[:-1]) > 0


def _with_runs(docs: DataFrame, most: int) -> DataFrame:
    """``docs`` with the columns ``_runs`` (array of start, end) and ``_copy`` (of a smaller document)."""
    marked = docs.withColumn("_mark", F.xxhash64("text"))
    known = marked.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_mark").alias("mark"),
        F.sha2("text", 256).alias("sha"), "text")
    ids = materialize(known.select("doc_id", "mark", "sha"), "ids")
    firsts = materialize(ids.groupBy("sha").agg(F.min("doc_id").alias("low")), "firsts")
    copies = materialize(ids.join(firsts, "sha").where("low < doc_id").select("doc_id", "mark").distinct(), "copies")
    single = known.select("doc_id", "mark", "text").join(copies, ["doc_id", "mark"], "left_anti")
    runs = spans(single, most).groupBy("doc_id", "mark").agg(
        F.collect_list(F.struct("start", "end")).alias("_runs"))
    notes = runs.withColumn("_copy", F.lit(False)).union(
        copies.select("doc_id", "mark", F.array().cast("array<struct<start:int,end:int>>"), F.lit(True)))
    notes = materialize(notes.withColumnsRenamed({"doc_id": "_id", "mark": "_m"}), "notes").dropDuplicates(["_id", "_m"])
    return marked.join(notes, (marked["doc_id"] == notes["_id"]) & (marked["_mark"] == notes["_m"]), "left")


def _kept(text: bytes, runs: list | None, copy: bool | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = text.split()
    if copy:
        return ([] if len(words) >= DEPTH else words), len(words)
    if not runs:
        return words, len(words)
    gone = _removed(len(words), runs)
    return [w for w, g in zip(words, gone) if not g], len(words)


def summaries(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every document row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in sliced(whole, "text", 4 << 20)):
            rows = [_kept(*x) for x in zip(raw_texts(batch.column("text")), batch.column("_runs").to_pylist(),
                                           batch.column("_copy").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for _, n in rows], pa.int64()),
                 pa.array([n - len(w) for w, n in rows], pa.int64()),
                 pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in rows], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_runs(docs.select("doc_id", "text"), most).select("doc_id", "text", "_runs", "_copy").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The documents, all columns, with repeated words cut out of the texts.

    A text that loses words becomes its kept words joined by spaces, and ``n_chars``, if there is such a
    column, its new length; documents that lose all their words are dropped; the others do not change.
    """
    names = docs.columns
    others = [n for n in names if n != "text"]  # the text goes once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in sliced(whole, "text", 4 << 20)):
            old, texts, keep = batch.column("text").to_pylist(), [], []
            for text, runs, copy in zip(old, batch.column("_runs").to_pylist(), batch.column("_copy").to_pylist()):
                words, n = _kept((text or "").encode(), runs, copy)
                texts.append(text if len(words) == n else b" ".join(words).decode())
                keep.append(bool(words) or not n)
            columns = dict(zip(others, batch.column("_row").flatten()))
            columns["text"] = pa.array(texts, batch.column("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(
                    [n if new == was else len(new) for n, new, was in zip(columns["n_chars"].to_pylist(), texts, old)],
                    columns["n_chars"].type)
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in names}).filter(pa.array(keep, pa.bool_()))

    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{n}`") for n in others)).alias("_row"))
    return _with_runs(rows, most).select("text", "_row", "_runs", "_copy").mapInArrow(run, docs.schema)
