"""Benchmark decontamination within an edit distance.

A document leaks an item if some run of its words is within ``floor((1 - similarity) * n)`` word edits
of the item's n words. Words are compared lower-cased (A-Z) and without ASCII punctuation at their
ends; tokens of punctuation alone are skipped.

Candidates come from random walks (the CGK embedding) and bit sampling. A walk reads a sequence of words
step by step; whether it moves on to the next word or reads the same one again is a random bit of the word
and the step, so two sequences that differ by an edit fall in step again soon, and edit distance becomes
Hamming distance of what is read. Windows of the items and of the documents, one from every word on, are
read by the same walks; samples of ``PLACES`` steps each, near ones and such that span the whole window,
are keys of a hash table. A window has the words of the shortest item, ``WINDOW`` at most. A sample of an
item counts if it read ``LEAST`` different words of the item; a document's window with the same key says
where the item would start, to within k words. It is a candidate if all but k of the item's words are
within k words of their place, as any leak's are, and is then verified by the exact edit distance of the
whole item to the part of the document around it.

The number of walks follows from the target recall: ``walks_for`` edits random items, of the shortest
length for each number of edits, and adds walks until the share found reaches ``RECALL`` at every length.
Items of fewer than ``SHORT`` words have too few for samples and are looked up exactly: with at most k
edits, one of k + 1 parts is unedited, so each part is looked up at every word.

Items are held by every task, in blocks of at most ``MOST_ITEMS`` items and ``MOST_BYTES`` bytes; a
larger benchmark takes several passes over the documents. Items without words, or null, take no part;
items of so few words that none may be edited are found by exact copies. Null and empty documents leak
nothing. Repeated items are reported by their ids.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix, raw_texts, sliced

SIMILARITY = 0.8
LONGEST = 8  # words in a part that is looked up
SHORT = 10  # words from which on items are found by walks
WINDOW = 16  # most words in a window
NEAR = (6, 8, 12)  # steps from which near samples are drawn; one more is drawn from the whole walk
PLACES, LEAST = 4, 3  # steps in a sample, different words in it
RECALL, TRIALS, MOST_WALKS = 0.999, 1000, 32
MOST_ITEMS, MOST_BYTES = 20_000, 16 << 20
TABLE = 20  # bits of the first look-up, 16 at least
CANDIDATES = 1 << 20  # places that are compared in one go
PUNCTUATION = string.punctuation.encode()


class _Words(WordHashes):
    """Hashes of normalised words; 0 for tokens that are skipped."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        plain = word.lower().strip(PUNCTUATION)
        value = self[word] = (xxhash.xxh3_64_intdigest(plain) or 1) if plain else 0
        return value

    def text(self, text: bytes) -> np.ndarray:
        hashes = self.of(text.split())
        return hashes[hashes > 0]


def _runs(hashes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the ascending sizes, the hash of every run of so many words."""
    out = np.zeros(len(hashes), np.uint64)
    for i in range(min(max(sizes), len(hashes))):
        n = len(hashes) - i
        out = mix(out[:n] + hashes[i:] + np.uint64(0x9E3779B97F4A7C15))
        if i + 1 in sizes:
            yield i + 1, out


def edits(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Fewest word edits between the item and any run of ``words``, and where that run ends."""
    row = np.zeros(len(words) + 1, np.int64)
    ramp = np.arange(len(words) + 1)
    for i, word in enumerate(item):
        down = row + 1
        down[1:] = np.minimum(down[1:], row[:-1] + (words != word))
        down[0] = i + 1
        row = np.minimum.accumulate(down - ramp) + ramp
    return int(row.min()), int(row.argmin())


class Walks:
    """Random walks over words and the samples that are taken of each."""

    def __init__(self, window: int, count: int = MOST_WALKS, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.walks = []
        for _ in range(count):
            factor = np.uint64(draw.integers(1 << 62)) * np.uint64(2) + np.uint64(1)
            self.walks.append((factor, [np.array(sorted(
                [0, *draw.choice(np.arange(1, span), PLACES - 1, replace=False)])) for span in (*NEAR, 2 * window)]))

    def keys(self, words: np.ndarray, walk: int, items: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """For each sample, the key of the window from every word on, and for items whether it counts.

        Texts stand one after another in ``words`` with a zero after each, where walks stay.
        """
        factor, samples = self.walks[walk]
        moves = ((words * factor) >> np.uint64(32)).astype(np.uint32)  # a bit for each of 32 steps
        at = np.arange(len(words), dtype=np.int32)
        keys = [np.zeros(len(words), np.uint64) for _ in samples]
        last = [np.full(len(words), -1, np.int32) for _ in samples] if items else []
        different = [np.zeros(len(words), np.int32) for _ in samples]
        whole = [np.ones(len(words), bool) for _ in samples]
        for step in range(int(max(s[-1] for s in samples)) + 1):
            reading = [k for k, sample in enumerate(samples) if step in sample]
            if reading:
                word = words[at]
                for k in reading:
                    keys[k] = (keys[k] + word) * np.uint64(0x9E3779B97F4A7C15)
                    if items:
                        different[k] += at != last[k]
                        last[k] = at
                        whole[k] &= word > 0
            at = at + ((moves[at] >> np.uint32(step)) & np.uint32(1)).astype(np.int32)
        for key, many, full in zip(keys, different, whole):
            yield mix(key), full & (many >= LEAST) if items else None


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another with a zero after each, and where each one starts."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    words = np.zeros(sum(len(t) + 1 for t in texts), np.uint64)
    for text, start in zip(texts, starts):
        words[start:start + len(text)] = text
    return words, starts


def edited(words: np.ndarray, edits: int, draw: np.random.Generator) -> np.ndarray:
    """The words after random edits: each replaces, inserts or deletes one."""
    out = words.tolist()
    for kind, place, fresh in zip(draw.integers(3, size=edits), draw.random(edits), draw.integers(1, 1 << 62, edits)):
        at = int(place * len(out))
        if kind == 0:
            out[at] = fresh
        elif kind == 1:
            out.insert(at, fresh)
        else:
            del out[at]
    return np.array(out, np.uint64)


def walks_for(sizes: dict[int, int], window: int, recall: float = RECALL, trials: int = TRIALS) -> int:
    """How many walks find the share ``recall`` of items of each size with its number of edits."""
    draw, walks, rest = np.random.default_rng(2), Walks(window), {}
    for size, edits in sizes.items():
        fresh = lambda n: draw.integers(1, 1 << 62, n).astype(np.uint64)
        items = [fresh(size) for _ in range(trials)]
        texts = [np.concatenate([fresh(4), edited(item, edits, draw), fresh(4)]) for item in items]
        rest[size] = [*(np.repeat(np.arange(trials), [len(x) + 1 for x in side]) for side in (items, texts)),
                      *(laid_out(side)[0] for side in (items, texts)), np.zeros(trials, bool)]
    for count in range(1, MOST_WALKS + 1):
        for of_item, of_text, items, texts, found in rest.values():
            for (key, counts), (other, _) in zip(walks.keys(items, count - 1, True), walks.keys(texts, count - 1)):
                pairs = [mix(k ^ mix(o.astype(np.uint64))) for k, o in ((key, of_item), (other, of_text))]
                found[of_text[np.isin(pairs[1], pairs[0][counts])]] = True
        if all(r[-1].mean() >= recall for r in rest.values()):
            return count
    raise ValueError("the target recall takes more walks than there are")


class Table:
    """Places of items by 64-bit key."""

    def __init__(self, keys: np.ndarray, items: np.ndarray, offsets: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.items, self.offsets = keys[order], items[order], offsets[order]
        self.shift = np.uint64(64 - min(24, max(16, TABLE, len(keys).bit_length() + 4)))
        self.mask = np.zeros(1 << (64 - int(self.shift)), bool)
        self.mask[keys >> self.shift] = True

    def meeting(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in ``values``, items and their offsets that have one key, a bounded number at a time."""
        near = np.flatnonzero(self.mask[values >> self.shift])
        low, high = (np.searchsorted(self.keys, values[near], side) for side in ("left", "right"))
        near, low, count = near[high > low], low[high > low], (high - low)[high > low]
        most, first = np.cumsum(count), 0
        while first < len(near):
            before = most[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(most, before + CANDIDATES, "right")))
            of = slice(first, last)
            entry = np.repeat(low[of] - most[of] + count[of], count[of]) + np.arange(before, most[last - 1])
            yield np.repeat(near[of], count[of]), self.items[entry], self.offsets[entry]
            first = last


class Items:
    """A block of benchmark items, ready for look-up."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, recall: float = RECALL):
        if not 0 < similarity <= 1:
            raise ValueError("similarity has to be above 0 and at most 1")
        hashes = _Words()
        words = [(i, hashes.text((t or "").encode())) for i, t in items]
        self.items = [(i, w) for i, w in words if len(w)]
        if not self.items:
            return
        self.sizes = np.array([len(w) for _, w in self.items])
        self.allowed = np.array([math.floor((1 - similarity) * n + 1e-9) for n in self.sizes])
        self.words, self.base = np.concatenate([w for _, w in self.items]), np.cumsum(self.sizes) - self.sizes
        # more edits than a fourth of the words leave too little for samples
        walked = (self.sizes >= SHORT) & (4 * self.allowed <= self.sizes)
        self._by_parts(np.flatnonzero(~walked))
        self._by_walks(np.flatnonzero(walked), recall)

    def _by_parts(self, chosen: np.ndarray) -> None:
        """Tables of the items' parts, by their length."""
        seeds: dict[int, list] = {}
        for k in chosen.tolist():
            w, most = self.items[k][1], self.allowed[k]
            edges = np.arange(most + 2) * len(w) // (most + 1)
            lengths = np.minimum(np.diff(edges), LONGEST)
            for size, runs in _runs(w, sorted(set(lengths.tolist()))):
                at = edges[:-1][lengths == size]
                seeds.setdefault(size, []).append((runs[at], np.full(len(at), k), at))
        self.parts = {size: Table(*(np.concatenate(x) for x in zip(*seeds[size]))) for size in sorted(seeds)}

    def _by_walks(self, chosen: np.ndarray, recall: float) -> None:
        """A table for each sample of each walk."""
        self.samples: list[list[Table]] = []
        if not len(chosen):
            return
        window = min(WINDOW, int(self.sizes[chosen].min()))
        sizes: dict[int, int] = {}
        for most in np.unique(self.allowed[chosen]).tolist():
            sizes[int(self.sizes[chosen][self.allowed[chosen] == most].min())] = most
        hardest = dict(sorted(sizes.items(), key=lambda x: (-x[1] / x[0], x[0]))[:8])
        self.walks = Walks(window, walks_for(hardest, window, recall))
        words, starts = laid_out([self.items[k][1] for k in chosen])
        item = np.repeat(chosen, self.sizes[chosen] + 1)
        offset = np.arange(len(words)) - np.repeat(starts, self.sizes[chosen] + 1)
        for walk in range(len(self.walks.walks)):
            self.samples.append([Table(key[counts], item[counts], offset[counts])
                                 for key, counts in self.walks.keys(words, walk, True)])

    def _meeting(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        """Arrays of texts, items and where they would start in ``words``, a bounded number at a time."""
        def found(table: Table, values: np.ndarray, size: int) -> Iterator[tuple]:
            for near, items, offsets in table.meeting(values):
                text = np.searchsorted(starts, near, "right") - 1
                inside = near + size <= ends[text]
                yield text[inside], items[inside], (near - offsets)[inside]

        if self.parts:
            for size, values in _runs(words, list(self.parts)):
                yield from found(self.parts[size], values, size)
        for walk, tables in enumerate(self.samples):
            for (values, _), table in zip(self.walks.keys(words, walk), tables):
                yield from found(table, values, 1)

    def _distinct(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        """What ``_meeting`` finds, each text, item and start mostly once."""
        held, count = [], 0
        longest = int(self.sizes.max())
        span = len(words) + longest

        def settled() -> tuple:
            text, item, start = (np.concatenate(x) for x in zip(*held))
            place = np.unique((text * span + start + longest) * len(self.items) + item, return_index=True)[1]
            return text[place], item[place], start[place]

        for part in self._meeting(words, starts, ends):
            held.append(part)
            count += len(part[0])
            if count >= CANDIDATES:
                yield settled()
                held, count = [], 0
        if held:
            yield settled()

    def _likely(self, words: np.ndarray, lows: np.ndarray, highs: np.ndarray, items: np.ndarray,
                starts: np.ndarray) -> np.ndarray:
        """Which candidates have all but the allowed number of words within that number of their places.

        ``words`` ends with a zero. ``lows`` and ``highs`` bound the candidates' texts.
        """
        good = np.zeros(len(starts), bool)
        for most in np.unique(self.allowed[items]):
            these = np.flatnonzero(self.allowed[items] == most)
            shifts = np.arange(-most, most + 1)
            step = max(1, CANDIDATES // len(shifts))
            for part in range(0, len(these), step):
                left, place = these[part:part + step], 0
                missing = np.zeros(len(left), np.int64)
                while len(left):
                    item = items[left]
                    at = (starts[left] + place)[:, None] + shifts
                    at[(at < lows[left, None]) | (at >= highs[left, None])] = len(words) - 1
                    missing += (words[at] != self.words[self.base[item] + place][:, None]).all(axis=1)
                    place += 1
                    done = self.sizes[item] == place
                    good[left[done & (missing <= most)]] = True
                    going = ~done & (missing <= most)
                    left, missing = left[going], missing[going]
        return good

    def leaks(self, texts: list[np.ndarray]) -> list[dict[int, int]]:
        """Per text, item id -> fewest edits, of the items it leaks."""
        out: list[dict[int, int]] = [{} for _ in texts]
        if not self.items or not any(map(len, texts)):
            return out
        words, base = laid_out(texts)
        ends = base + [len(t) for t in texts]
        places: dict[tuple[int, int], set] = {}
        for text, item, start in self._distinct(words, base, ends):
            good = self._likely(words, base[text], ends[text], item, start)
            text, item, start = text[good], item[good], start[good] - base[text[good]]
            for t, k, at in zip(text.tolist(), item.tolist(), start.tolist()):
                places.setdefault((t, k), set()).add(at)
        for (text, item), starts in places.items():
            item_id, most = self.items[item][0], int(self.allowed[item])
            fewest = min(n for low, high in self._stretches(item, starts)
                         for n in edits(self.items[item][1], texts[text][max(0, low):high])[:1])
            if fewest <= most and fewest < out[text].get(item_id, most + 1):
                out[text][item_id] = fewest
        return out

    def _stretches(self, item: int, starts: set[int]) -> list[list[int]]:
        """The words in which the item, starting there or nearby, can lie; overlapping stretches in one."""
        out: list[list[int]] = []
        for start in sorted(starts):
            low, high = start - self.allowed[item], start + self.sizes[item] + self.allowed[item]
            if out and low <= out[-1][1]:
                out[-1][1] = high
            else:
                out.append([low, high])
        return out


def _blocks(items: DataFrame, similarity: float) -> Iterator[Items]:
    """The benchmark in blocks of bounded size."""
    size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, math.ceil(size[0] / MOST_ITEMS), math.ceil(size[1] / MOST_BYTES))
    for k in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        yield Items(sorted(((r["item_id"], r["text"]) for r in rows.select("item_id", "text").collect()
                            if r["item_id"] is not None), key=lambda r: r[0]), similarity)


def _found(block: Items, hashes: _Words, batch: pa.RecordBatch) -> list[dict[int, int]]:
    return block.leaks([hashes.text(t) for t in raw_texts(batch.column("text"))])


def find(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_ids, item_edits) for every document; the ids ascend.

    ``docs`` has (doc_id, text) and ``items`` (item_id, text).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, item_ids array<long>, item_edits array<int>"
    frame = docs.select(
        "doc_id", "text", F.array().cast("array<long>").alias("item_ids"),
        F.array().cast("array<int>").alias("item_edits"))
    for block in _blocks(items, similarity):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes = _Words()
            for whole in batches:
                for batch in sliced(whole, "text", 4 << 20):
                    ids, counts = [], []
                    for more, old, had in zip(_found(shared.value, hashes, batch),
                                              batch.column("item_ids").to_pylist(),
                                              batch.column("item_edits").to_pylist()):
                        both = sorted((dict(zip(old, had)) | more).items())
                        ids.append([i for i, _ in both])
                        counts.append([n for _, n in both])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id"), batch.column("text"),
                         pa.array(ids, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))],
                        ["doc_id", "text", "item_ids", "item_edits"])

        frame = frame.mapInArrow(run, schema)
    return frame.select("doc_id", "item_ids", "item_edits")


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, that leak no item."""
    for block in _blocks(items, similarity):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes = _Words()
            for whole in batches:
                for batch in sliced(whole, "text", 4 << 20):
                    yield batch.filter(pa.array([not x for x in _found(shared.value, hashes, batch)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
