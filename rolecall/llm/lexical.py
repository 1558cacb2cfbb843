"""Ranked lexical search: the best documents of each item by term weights, with a dual-tree search.

Items and documents are vectors over terms: an item holds its terms' weights, a document each term's
saturated frequency, and a score is their inner product in whole numbers. Both are arranged in trees.
Every node holds the coordinate maxima of what is below it, so the inner product of two nodes bounds the
score of every pair below them. The search goes down both trees at once, a level at a time for all pairs
of nodes, and drops a pair whose bound is below the weakest kth score among the node's items: whole
batches of documents for whole batches of items, without losing a result. At the leaves, whole documents
are scored.

The documents are tokenised once, into blocks of sparse vectors over the items' terms, in the order of
their tree: a set of documents is split by the term that tells most about it until it is a leaf. Sums over
the blocks give the statistics of all documents. A first pass scores, in each block, every item's most
promising leaf; the kth best of those scores is where the search starts from, in every task. The second
pass searches all blocks; each task keeps k documents an item, and a window ranks what the tasks found.

Items are held by every task, in blocks of at most ``MOST_BYTES`` bytes of text; a larger table of items
takes several passes over the documents. Trees have at most ``TREE`` items.

Terms are the maximal runs of ASCII letters and digits and all other characters from U+0080 on, with A-Z
in lower case. Null and empty texts have no terms and take no part. Rows that repeat an item id are one
item with the terms of all; items without an id are left out. Documents without an id count in the
statistics but are not ranked; rows that repeat a document are ranked one by one. Equal scores rank by
document id. With fewer than k documents above a score of 0 all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, packed, raw_texts, sliced

MOST_BYTES = 8 << 20  # bytes of items' texts that a task holds
BLOCK = 4 << 20  # bytes of documents' texts in a block
LEAF = 32  # documents
TREE = 256  # items
TO_TERMS = bytes(ord(chr(c).lower()) if c >= 128 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TO_TERMS).split()


def tree_order(owner: np.ndarray, term: np.ndarray, n: int, leaf: int) -> np.ndarray:
    """An order of n sets such that neighbours are alike: sets are split by one term until they are leaves.

    ``owner`` ascends and has each set's number once for each of its terms.
    """
    starts = np.searchsorted(owner, np.arange(n + 1))
    held, term = np.unique(term, return_inverse=True)
    idf = np.log(1 + n / np.maximum(1, np.bincount(term, minlength=len(held))))
    out, stack = [], [np.arange(n)]
    while stack:
        sets = stack.pop()
        if len(sets) > leaf:
            sizes = starts[sets + 1] - starts[sets]
            at = np.arange(sizes.sum()) + np.repeat(starts[sets] - np.cumsum(sizes) + sizes, sizes)
            share = np.bincount(term[at], minlength=len(held)) / len(sets)
            gain = idf * share * (1 - share)
            if len(gain) and gain.max() > 0:
                has = np.isin(sets, owner[at[term[at] == gain.argmax()]])
                stack += [sets[~has], sets[has]]
                continue
        out.append(sets)
    return np.concatenate(out)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that start at ``starts``, one run after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


@dataclass
class Level:
    """Nodes of one level of an item tree: each node's terms and their largest weights."""

    starts: np.ndarray
    sizes: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


class ItemTree:
    """Items with their terms' weights, and the levels from the root down to single items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], weights: np.ndarray):
        owner = np.repeat(np.arange(len(items)), [len(t) for _, t in items])
        order = tree_order(owner, np.concatenate([t for _, t in items]), len(items), 1)
        self.ids = np.array([items[i][0] for i in order], np.int64)
        nodes = [np.sort(items[i][1]) for i in order]
        self.levels: list[Level] = []
        while True:
            sizes = np.array([len(t) for t in nodes])
            flat = np.concatenate(nodes)
            self.levels.insert(0, Level(np.cumsum(sizes) - sizes, sizes, flat, weights[flat]))
            if len(nodes) == 1:
                break
            nodes = [np.unique(np.concatenate(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]
        self.terms = np.unique(self.levels[0].terms)

    def weakest(self, kth: np.ndarray) -> list[np.ndarray]:
        """For each level, the smallest kth score of the items below each node."""
        out = [kth]
        while len(out[0]) > 1:
            out.insert(0, np.minimum.reduceat(out[0], np.arange(0, len(out[0]), 2)))
        return out


class Documents:
    """A block of documents over one item tree's terms, and the levels of coordinate maxima above them."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, term: np.ndarray, value: np.ndarray, tree: ItemTree):
        self.ids = ids
        place = np.searchsorted(tree.terms, term)
        place[place == len(tree.terms)] = 0
        known = tree.terms[place] == term
        columns, column = np.unique(place[known], return_inverse=True)
        self.column = np.full(len(tree.terms), len(columns))  # the last column is of terms that no document has
        self.column[columns] = np.arange(len(columns))
        leaves = -(-len(ids) // LEAF)
        self.rows = np.zeros((leaves * LEAF, len(columns) + 1), np.float32)
        self.rows[owner[known], column] = value[known]
        maxima = self.rows.reshape(leaves, LEAF, -1).max(axis=1)
        self.levels = [maxima]
        while len(self.levels[0]) > 1:
            self.levels.insert(0, np.maximum.reduceat(self.levels[0], np.arange(0, len(self.levels[0]), 2), axis=0))

    def bounds(self, tree: ItemTree, level: Level, nodes: np.ndarray, maxima: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Inner products of pairs of nodes, rounded up."""
        sizes = level.sizes[nodes]
        at = _ragged(level.starts[nodes], sizes)
        columns = self.column[np.searchsorted(tree.terms, level.terms[at])]
        products = maxima[np.repeat(others, sizes), columns] * level.weights[at]
        return np.add.reduceat(products, np.cumsum(sizes) - sizes) * (1 + 1e-9) if len(nodes) else np.zeros(0)

    def scores(self, tree: ItemTree, item: int, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents in those leaves with a score above 0 for one item, and the scores."""
        level = tree.levels[-1]
        its = slice(level.starts[item], level.starts[item] + level.sizes[item])
        columns = self.column[np.searchsorted(tree.terms, level.terms[its])]
        rows = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        found = self.rows[np.ix_(rows, columns)].astype(np.int64) @ level.weights[its].astype(np.int64)
        return rows[found > 0], found[found > 0]

    def alive(self, tree: ItemTree, weakest: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of an item and a leaf that the bounds leave."""
        nodes, others, down, across = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
        while True:
            level, maxima = tree.levels[down], self.levels[across]
            bound = self.bounds(tree, level, nodes, maxima, others)
            keep = (bound >= weakest[down][nodes]) & (bound > 0)
            nodes, others = nodes[keep], others[keep]
            last = down == len(tree.levels) - 1, across == len(self.levels) - 1
            if all(last):
                return nodes, others
            if not last[0]:
                down += 1
                nodes, others = (2 * nodes[:, None] + [0, 1]).ravel(), np.repeat(others, 2)
                there = nodes < len(tree.levels[down].sizes)
                nodes, others = nodes[there], others[there]
            if not last[1]:
                across += 1
                nodes, others = np.repeat(nodes, 2), (2 * others[:, None] + [0, 1]).ravel()
                there = others < len(self.levels[across])
                nodes, others = nodes[there], others[there]


class Best:
    """The k best documents of each item of a tree so far."""

    def __init__(self, tree: ItemTree, k: int, kth: dict[int, int]):
        self.k = k
        self.kth = np.array([kth.get(i, 1) for i in tree.ids.tolist()], np.float64)
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in tree.ids]

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.kth[item]
        if not good.any():
            return
        ids, scores = (np.concatenate([h, x[good]]) for h, x in zip(self.held[item], (ids, scores)))
        first = np.lexsort((ids, -scores))[:self.k]
        self.held[item] = ids[first], scores[first]
        if len(first) == self.k:
            self.kth[item] = max(self.kth[item], scores[first[-1]])


@dataclass
class Statistics:
    """What the scores take from all documents, and the items' trees."""

    trees: list[ItemTree]
    n_docs: int
    n_terms: int


def _ids_of_terms(rows: list, k: int = 0) -> tuple[dict[bytes, int], list[tuple[int, np.ndarray]]]:
    """Numbers of all terms of (item_id, text) rows, and each item's terms by number."""
    held: dict[int, set[bytes]] = {}
    for item_id, text in rows:
        if item_id is not None:
            held.setdefault(item_id, set()).update(terms((text or "").encode()))
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*held.values())))}
    return vocabulary, [(i, np.array(sorted(vocabulary[t] for t in held[i]), np.int64)) for i in sorted(held) if held[i]]


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Blocks of sparse vectors of the documents over the vocabulary, with the block's share of the statistics.

    A block has (block, n_docs, n_terms), its documents' ``ids`` and ``lengths`` in the order of their tree,
    ``owner``, ``term`` and ``tf`` of each entry, and how many documents hold each of its terms.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = TaskContext.get().partitionId() << 33, shared.value
        for whole in batches:
            for batch in sliced(whole, "text", BLOCK):
                codes, lengths = [], []
                for text in raw_texts(batch.column("text")):
                    found = terms(text)
                    lengths.append(len(found))
                    codes.append(np.fromiter(map(known.get, found, repeat(-1)), np.int64, len(found)))
                lengths = np.array(lengths, np.int64)
                owner, code = np.repeat(np.arange(len(lengths)), lengths), np.concatenate(codes)
                owner, code = owner[code >= 0], code[code >= 0]
                entry, tf = np.unique(owner * max(1, len(known)) + code, return_counts=True)
                owner, term = np.divmod(entry, max(1, len(known)))
                held, times = np.unique(term, return_counts=True)
                stats = [pa.array([number], pa.int64()), pa.array([int((lengths > 0).sum())], pa.int64()),
                         pa.array([int(lengths.sum())], pa.int64()), packed([held], pa.int64()), packed([times], pa.int64())]
                # only documents with an id and a term of some item can be ranked
                keep = np.zeros(len(lengths), bool)
                keep[owner] = True
                keep &= batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                new = np.cumsum(keep) - 1
                its = keep[owner]
                owner, term, tf = new[owner[its]], term[its], tf[its]
                kept = np.flatnonzero(keep)
                order = tree_order(owner, term, len(kept), LEAF)
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                ids = batch.column("doc_id").take(pa.array(kept[order])).to_numpy(zero_copy_only=False)
                blob = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*stats, blob(ids, np.int64), blob(lengths[kept[order]], np.int64),
                     blob(rank[owner], np.int32), blob(term, np.int32), blob(tf, np.int32)],
                    ["block", "n_docs", "n_terms", "held", "times", "ids", "lengths", "owner", "term", "tf"])
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "block long, n_docs long, n_terms long, held array<long>, times array<long>, "
             "ids binary, lengths binary, owner binary, term binary, tf binary")


def statistics(blocks: DataFrame, items: list[tuple[int, np.ndarray]], size: int) -> Statistics:
    """Sums over all blocks; what reaches the driver is one number for each term of the items."""
    total = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    holding = np.zeros(size, np.int64)
    counted = (blocks.select(F.explode(F.arrays_zip("held", "times")).alias("x"))
               .groupBy("x.held").agg(F.sum("x.times").alias("n")).toPandas())
    holding[counted["held"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    weights = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * n + 1))) for n in holding.tolist()], np.float64)
    order = tree_order(np.repeat(np.arange(len(items)), [len(t) for _, t in items]),
                       np.concatenate([t for _, t in items]), len(items), TREE)
    trees = [ItemTree([items[i] for i in order[k:k + TREE]], weights) for k in range(0, len(order), TREE)]
    return Statistics(trees, *total)


def _searched(blocks: DataFrame, shared, k: int, kth: dict[int, int], seeds: bool) -> DataFrame:
    """(item_id, doc_id, score): the k best of each task, from the most promising leaves only or from all."""
    floor = blocks.sparkSession.sparkContext.broadcast(kth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Statistics = shared.value
        best = [Best(tree, k, floor.value) for tree in known.trees]
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = (np.frombuffer(row[c], np.int64) for c in ("ids", "lengths"))
                if not len(ids):
                    continue
                owner, term, tf = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("owner", "term", "tf"))
                damped = 10 + 90 * lengths * known.n_docs // known.n_terms
                value = 1_000_000_000 * tf // (1000 * tf + 8 * damped[owner])
                for tree, held in zip(known.trees, best):
                    block = Documents(ids, owner, term, value, tree)
                    if seeds:
                        n, leaves = len(tree.ids), len(block.levels[-1])
                        bounds = block.bounds(tree, tree.levels[-1], np.repeat(np.arange(n), leaves),
                                              block.levels[-1], np.tile(np.arange(leaves), n))
                        pairs = np.arange(n), bounds.reshape(n, leaves).argmax(axis=1)
                    else:
                        pairs = block.alive(tree, tree.weakest(held.kth))
                    order = np.argsort(pairs[0], kind="stable")
                    items, first = np.unique(pairs[0][order], return_index=True)
                    for item, some in zip(items.tolist(), np.split(pairs[1][order], first[1:])):
                        at, scores = block.scores(tree, item, some)
                        held.add(item, ids[at], scores)
        for tree, held in zip(known.trees, best):
            for item_id, (ids, scores) in zip(tree.ids.tolist(), held.held):
                if len(ids):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item_id] * len(ids), pa.int64()), pa.array(ids), pa.array(scores)],
                        ["item_id", "doc_id", "score"])

    return (blocks.select("ids", "lengths", "owner", "term", "tf")
            .mapInArrow(run, "item_id long, doc_id long, score long"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, math.ceil(size / MOST_BYTES))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    known = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    for part in range(passes):
        rows = known.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == part).collect()
        vocabulary, some = _ids_of_terms(rows)
        if not some:
            continue
        blocks = materialize(vectors(docs, vocabulary), "vectors")
        found = statistics(blocks, some, len(vocabulary))
        if not found.n_docs:
            continue
        shared = spark.sparkContext.broadcast(found)
        seeds = _ranked(materialize(_searched(blocks, shared, k, {}, True), "seeds"), k)
        kth = {r["item_id"]: r["score"] for r in seeds.where(F.col("rank") == k).collect()}  # a row an item at most
        out = out.union(_ranked(_searched(blocks, shared, k, kth, False), k))
    return out
