"""SentencePiece encoding and decoding with a unigram model.

The vocabulary file gives pieces and scores; a piece's log score follows Zipf's law over the pieces'
stored order (``scores="zipf"``), as the stored ones of a merge-based vocabulary are ranks, or is taken
as stored. Pieces sit in a double-array trie over their UTF-8 bytes. Encoding finds the best-scoring
segmentation (Viterbi); a character no piece covers is spelled in byte pieces. A text gets one leading
space, and spaces become the marker U+2581. Decoding reads markers as spaces, byte pieces as raw bytes,
and drops the leading space.

No piece holds a marker after another character, so a best path never crosses from a character into a
space: the text is cut there, and each distinct cut of a batch is segmented once, many at a time.
Cuts over ``LONG`` bytes are segmented one by one with the same trie. A marker character in the text
itself is spelled in bytes, so decoding gives every text back exactly. Null texts stay null, with null
ids; an empty text has no ids.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import sliced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
UNKNOWN_PENALTY = 10.0
LONG = 48
IDS = T.StructField("piece_ids", T.ArrayType(T.IntegerType()))
MEMO = 200_000  # distinct cuts a worker remembers between batches
SLICE = 2 << 20  # bytes of text that are segmented in one go
CUT = re.compile(rb" *[^ ]+| +")


@dataclass
class Trie:
    """Double array: the child of node s by byte c is base[s] + c if check holds s there."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(words: dict[bytes, int]) -> Trie:
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for word, value in words.items():
            node = 0
            for c in word:
                if c not in tree[node]:
                    tree[node][c] = len(tree)
                    tree.append({})
                node = tree[node][c]
            ends[node] = value
        size = len(tree) + 16384
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        value = np.full(size, -1, np.int32)
        check[0] = 0
        place, free, queue = {0: 0}, 1, [0]
        for node in queue:
            at = place[node]
            value[at] = ends.get(node, -1)
            if not (children := tree[node]):
                continue
            codes = np.array(sorted(children))
            while check[free] >= 0:
                free += 1
            since = free
            while True:  # the first free slot where all children fit
                if since + 8192 > len(check):
                    base, check, value = (
                        np.concatenate([x, np.full(len(x) + 8192, fill, np.int32)])
                        for x, fill in ((base, 0), (check, -1), (value, -1)))
                starts = since + np.flatnonzero(check[since:since + 4096] < 0) - codes[0]
                starts = starts[starts > 0]
                fits = (check[starts[:, None] + codes] < 0).all(axis=1)
                if fits.any():
                    start = int(starts[fits.argmax()])
                    break
                since += 4096
            base[at] = start
            check[start + codes] = at
            for c, child in children.items():
                place[child] = start + c
                queue.append(child)
        return Trie(base, check, value)


class Vocabulary:
    """Pieces, their scores, and segmentation."""

    def __init__(self, surfaces: list[bytes], scores: np.ndarray, bytes_at: np.ndarray):
        """``surfaces`` hold spaces for markers; empty ones (control pieces) never match."""
        self.surfaces, self.scores, self.bytes_at = surfaces, scores, bytes_at
        spelled = set(bytes_at.tolist())
        words = {s: i for i, s in enumerate(surfaces) if s and i not in spelled and MARK not in s}
        self.trie = Trie.of(words)
        self.unknown = float(scores.min()) - UNKNOWN_PENALTY
        self.sizes = np.array([len(s) for s in surfaces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.blob = np.frombuffer(b"".join(surfaces), np.uint8)
        self.memo: dict[bytes, np.ndarray] = {}
        self.deepest = max(map(len, words), default=1)

    @staticmethod
    def load(path: str = MODEL, scores: str = "zipf") -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        surfaces, stored, bytes_at = [], np.zeros(count), np.zeros(256, np.int64)
        rank = 0
        for i in range(count):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                code = int(piece[3:5], 16)
                bytes_at[code] = i
                surfaces.append(bytes([code]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surfaces.append(b"")
            else:
                rank += 1
                surfaces.append(piece.encode().replace(MARK, b" "))
                stored[i] = model.get_score(i) if scores == "stored" else -math.log(rank + 2.7)
        return Vocabulary(surfaces, stored, bytes_at)

    def segment(self, text: bytes) -> list[int]:
        """Best ids of one text, by the plain recurrence."""
        n = len(text)
        best, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(n):
            if best[i] == -math.inf:
                continue
            lead = text[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            covered, node, j = False, 0, i
            while j < n:
                child = int(base[node]) + text[j]
                if check[child] != node:
                    break
                node, j = child, j + 1
                if (v := int(value[node])) >= 0:
                    covered |= j - i == width
                    if (score := best[i] + self.scores[v]) > best[j]:
                        best[j], back[j], piece[j] = score, i, v
            if not covered and (score := best[i] + self.unknown) > best[i + width]:
                best[i + width], back[i + width], piece[i + width] = score, i, -1
        out, j = [], n
        while j:
            i = back[j]
            out.append([piece[j]] if piece[j] >= 0 else self.bytes_at[list(text[i:j])].tolist())
            j = i
        return [x for part in reversed(out) for x in part]

    def segment_many(self, texts: list[bytes]) -> list[np.ndarray]:
        """Best ids of short texts, all advanced together place by place."""
        n, width = len(texts), max(map(len, texts))
        grid = np.zeros((n, width + 4), np.int64)
        for i, text in enumerate(texts):
            grid[i, :len(text)] = np.frombuffer(text, np.uint8)
        size = np.array([len(t) for t in texts])
        best = np.full((n, width + 5), -np.inf)
        back = np.zeros((n, width + 5), np.int16)
        piece = np.full((n, width + 5), -1, np.int32)
        best[:, 0] = 0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            rows = np.flatnonzero((best[:, i] > -np.inf) & (size > i))
            lead = grid[rows, i]
            need = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            covered = np.zeros(n, bool)
            needed = np.zeros(n, np.int64)
            needed[rows] = need
            live, node = rows, np.zeros(len(rows), np.int64)
            for j in range(i, min(width, i + self.deepest)):
                child = base[node] + grid[live, j]
                good = (check[child] == node) & (size[live] > j)
                live, node = live[good], child[good]
                if not len(live):
                    break
                v = value[node]
                ends = v >= 0
                r, v = live[ends], v[ends]
                covered[r[needed[r] == j + 1 - i]] = True
                score = best[r, i] + self.scores[v]
                better = score > best[r, j + 1]
                r = r[better]
                best[r, j + 1], back[r, j + 1], piece[r, j + 1] = score[better], i, v[better]
            bare = rows[~covered[rows]]
            ends = i + needed[bare]
            better = best[bare, i] + self.unknown > best[bare, ends]
            bare, ends = bare[better], ends[better]
            best[bare, ends], back[bare, ends], piece[bare, ends] = best[bare, i] + self.unknown, i, -1
        return self._traced(texts, size, back, piece)

    def _traced(self, texts, size, back, piece) -> list[np.ndarray]:
        """Follow the back pointers of all rows at once."""
        rows, at = np.arange(len(texts)), size.copy()
        steps = []
        while len(rows):
            steps.append((rows, at, back[rows, at].astype(np.int64), piece[rows, at]))
            at = steps[-1][2]
            rows, at = rows[at > 0], at[at > 0]
        row, end, start, ids = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((start, row))
        row, end, start, ids = row[order], end[order], start[order], ids[order]
        if (ids < 0).any():
            spelled = [self.bytes_at[list(texts[r][s:e])] if i < 0 else np.array([i])
                       for r, s, e, i in zip(row, start, end, ids)]
            row = np.repeat(row, [len(x) for x in spelled])
            ids = np.concatenate(spelled)
        return np.split(ids, np.cumsum(np.bincount(row, minlength=len(texts)))[:-1])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of whole texts."""
        cuts = [CUT.findall(b" " + t) if t else [] for t in texts]
        place: dict[bytes, int] = {}
        order = np.fromiter(
            (place.setdefault(c, len(place)) for cut in cuts for c in cut), np.int64,
            sum(map(len, cuts)))
        known = list(place)
        ids: list = [None] * len(known)
        if len(self.memo) > MEMO:
            self.memo.clear()
        for i, cut in enumerate(known):
            ids[i] = self.memo.get(cut)
        short = sorted((i for i, c in enumerate(known) if ids[i] is None and len(c) <= LONG),
                       key=lambda i: len(known[i]))
        for start in range(0, len(short), 20_000):
            run = short[start:start + 20_000]
            for i, found in zip(run, self.segment_many([known[i] for i in run])):
                ids[i] = self.memo[known[i]] = found
        for i, cut in enumerate(known):
            if ids[i] is None:
                ids[i] = np.array(self.segment(cut), np.int64)
        if not known:
            return [np.zeros(0, np.int64) for _ in texts]
        flat, sizes = np.concatenate(ids), np.array([len(x) for x in ids])
        firsts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        lengths = sizes[order]
        ends = np.cumsum(lengths)
        values = flat[np.repeat(firsts[order] - ends + lengths, lengths) + np.arange(lengths.sum())]
        marks = np.concatenate([[0], ends])[np.cumsum([len(c) for c in cuts])]
        return np.split(values, marks[:-1])

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The texts that ids stand for."""
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        sizes = self.sizes[flat]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.blob[np.repeat(self.starts[flat] - ends + sizes, sizes) + np.arange(total)].tobytes()
        marks = np.concatenate([[0], ends])[np.cumsum([0, *(len(x) for x in ids)])]
        return [raw[a:b][1:] for a, b in zip(marks, marks[1:])]


def encode(docs: DataFrame, model: str = MODEL, scores: str = "zipf") -> DataFrame:
    """Every document's row, all columns, with ``piece_ids`` (array<int>)."""
    return _mapped(docs, model, scores, [IDS], _encoded)


def round_trip(docs: DataFrame, model: str = MODEL, scores: str = "zipf") -> DataFrame:
    """Every document's row with ``piece_ids`` and ``decoded`` (string), the text read back from them."""
    return _mapped(docs, model, scores, [IDS, T.StructField("decoded", T.StringType())], _both)


def _ids(vocabulary: Vocabulary, column: pa.Array) -> tuple[pa.ListArray, list[np.ndarray], np.ndarray]:
    texts = [(t or "").encode() for t in column.to_pylist()]
    ids = vocabulary.encode(texts)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    missing = np.array([not x for x in column.is_valid().to_pylist()], bool)
    return pa.ListArray.from_arrays(offsets, pa.array(values), mask=pa.array(missing)), ids, missing


def _encoded(vocabulary: Vocabulary, column: pa.Array) -> list[pa.Array]:
    return [_ids(vocabulary, column)[0]]


def _both(vocabulary: Vocabulary, column: pa.Array) -> list[pa.Array]:
    listed, ids, missing = _ids(vocabulary, column)
    read = [None if m else t.decode() for t, m in zip(vocabulary.decode(ids), missing)]
    return [listed, pa.array(read, pa.string())]


def _mapped(docs: DataFrame, model: str, scores: str, added: list[T.StructField], use) -> DataFrame:
    """Columns of ``docs`` that have the name of an added one are replaced."""
    names = [field.name for field in added]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                more = use(shared.value, batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *more], [*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
