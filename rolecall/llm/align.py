"""Alignment of two tokenizers' tokens over the same bytes.

Every text is encoded twice: by a byte-level BPE (A, which is given a leading space) and by a
SentencePiece BPE with byte fallback (B, which adds that space itself). Both token sequences spell the
same bytes, so they are merged like two sorted lists of ends: one state vector holds a pointer into A and
one into B for every document of a block, and each step emits the pair of tokens under the pointers as a
link, advances the pointer whose token ends first, or both where they end together, which is a cut
between groups. Finished documents are compacted away, so a step costs as many places as documents are
left.

Words repeat, so a worker encodes each distinct word once while it remembers it. A text may be cut before
a space that follows a letter or another visible ASCII character: neither tokenizer has a token across it.
Words that end otherwise stay joined to the next one. New words in Latin letters are encoded together, A's
by the same merges in another library, and cut apart again; all others go through A's own file one by one.

A link's count is the number of documents that hold the same pair of ids linked. Blocks of documents send
each distinct pair once with its number of documents; the sums are joined back to the blocks' pairs, so
what is moved grows with distinct pairs of blocks, not with links, and no table is held whole anywhere.

Texts that are null or empty, or that a tokenizer does not spell back, have no tokens: zeros and an empty
string. Rows that repeat a document, or have no id, count as documents of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed, sliced

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: how byte-level BPE splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 4 << 20  # bytes of text that are merged and sent in one block
LATIN = "\u024f"  # last character of words that are encoded together
MEMO = 200_000  # distinct words a worker remembers
SHIFT = 20  # bits of an id of B in a pair's key
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: visible Latin-1 characters stand for
    themselves, the other bytes in turn for the characters from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def piece_bytes(piece: str) -> bytes:
    spelled = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(spelled[1], 16)]) if spelled else piece.replace("▁", " ").encode()


def ends_visibly(word: str) -> bool:
    """Whether the word ends with a letter or a visible ASCII character."""
    return word[-1:].isalnum() if word[-1:] > "~" else word[-1:] > " "


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the words they have encoded.

    Only the paths travel to a worker; it loads the files when it first needs them and keeps them.
    """

    def __init__(self, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE):
        self.paths, self.first = (byte_bpe, piece_bpe), None

    def loaded(self) -> Tokenizers:
        if self.first is None:
            self._load(*self.paths)
        return self

    def _load(self, byte_bpe: str, piece_bpe: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_bpe)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        with open(byte_bpe, encoding="utf-8") as file:
            vocabulary = json.load(file)
        alphabet = byte_alphabet()
        entries = {i: bytes(map(alphabet.__getitem__, t)) for t, i in vocabulary["model"]["vocab"].items()
                   if i not in {x["id"] for x in vocabulary["added_tokens"]}}
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.b_bytes = [piece_bytes(self.second.id_to_piece(i)) for i in range(self.second.get_piece_size())]
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, special_tokens={},
                                      mergeable_ranks={t: i for i, t in entries.items()})
        self.a_sizes = np.array(list(map(len, self.a_bytes)))
        self.b_sizes = np.array(list(map(len, self.b_bytes)))
        self.place: dict[str, int] = {}
        self.spelled = np.zeros(0, bool)
        self.ids = Lists(), Lists()
        # decimal ids with what follows them in a group string: A's before another, A's last, B's before another, B's last
        a, b = range(len(self.a_bytes)), range(len(self.b_bytes))
        digits = [*(b"%d," % i for i in a), *(b"%d|" % i for i in a), *(b"%d," % i for i in b), *(b"%d;" % i for i in b)]
        width = max(map(len, digits))
        self.digits = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in digits), np.uint8).reshape(-1, width)

    def _forget(self, kept: list[str]) -> None:
        """Go on with those of the remembered words only."""
        rows = np.fromiter(map(self.place.__getitem__, kept), np.int64, len(kept))
        self.place = dict(zip(kept, range(len(kept))))
        self.spelled = self.spelled[rows]
        for side in self.ids:
            side.keep(rows)

    def _learn(self, words: set[str]) -> None:
        """Have the ids of all the words."""
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > MEMO:
            self._forget([w for w in words if w in self.place])
        together = [w for w in new if w[-1:] != " " and ends_visibly(w) and max(w) <= LATIN]
        apart = set(new).difference(together)
        for start in range(0, len(together), 10_000):
            some = together[start:start + 10_000]
            if not self._learn_together(some):
                apart.update(some)
        rest = list(apart)
        for start in range(0, len(rest), 10_000):
            some = rest[start:start + 10_000]
            ones = self.first.encode_batch_fast([" " + w for w in some], add_special_tokens=False)
            a, b = [x.ids for x in ones], self.second.encode(some, num_threads=1)
            whole = [(" " + w).encode() for w in some]
            good = [b"".join(map(self.a_bytes.__getitem__, x)) == w == b"".join(map(self.b_bytes.__getitem__, y))
                    for x, y, w in zip(a, b, whole)]
            self._add(some, good, *((np.fromiter(chain.from_iterable(x), np.int32), list(map(len, x))) for x in (a, b)))

    def _add(self, words: list[str], good, *sides: tuple[np.ndarray, np.ndarray]) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.spelled = np.concatenate([self.spelled, good]).astype(bool)
        for side, (ids, sizes) in zip(self.ids, sides):
            side.add(ids, sizes)

    def _learn_together(self, words: list[str]) -> bool:
        """Encode words in one go, in Latin letters, of which no token crosses a space; False if that fails."""
        text = " " + " ".join(words)
        whole = text.encode()
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        sides = []
        for ids, sizes, spelled in ((self.fast.encode_ordinary(text), self.a_sizes, self.a_bytes),
                                    (self.second.encode(text[1:], num_threads=1), self.b_sizes, self.b_bytes)):
            if b"".join(map(spelled.__getitem__, ids)) != whole:
                return False
            ids = np.array(ids, np.int32)
            at = np.cumsum(sizes[ids])
            last = np.searchsorted(at, ends)
            if (at[last] != ends).any():
                return False
            sides.append((ids, np.diff(last, prepend=-1)))
        self._add(words, np.ones(len(words), bool), *sides)
        return True

    @staticmethod
    def cut(words: list[str]) -> list[str]:
        """A text's pieces between spaces, joined to the next one where a token may cross the space."""
        out, held = [], []
        for word in words:
            held.append(word)
            if ends_visibly(word):
                out.append(" ".join(held))
                held = []
        if held == [""]:  # a space at the end, which B does not encode by itself
            out[-1] += " "
        elif held:
            out.append(" ".join(held))
        return out

    def flat(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B, the ids of all texts and how many each text has."""
        cuts = [t.split(" ") if t else [] for t in texts]
        odd = {w for w in set(chain.from_iterable(cuts)) if not ends_visibly(w)}
        if odd:
            cuts = [words if odd.isdisjoint(words) else self.cut(words) for words in cuts]
        flat = list(chain.from_iterable(cuts))
        self._learn(set(flat))
        rows = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(texts)), list(map(len, cuts)))
        failed = np.zeros(len(texts), bool)
        failed[owner[~self.spelled[rows]]] = True
        rows, owner = rows[~failed[owner]], owner[~failed[owner]]
        out = []
        for side in self.ids:
            ids, sizes = side.of(rows)
            out.append((ids, np.bincount(owner, sizes, len(texts)).astype(np.int64)))
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B for each text; none for texts without tokens."""
        return list(zip(*(np.split(ids, np.cumsum(sizes)[:-1]) for ids, sizes in self.flat(texts)))) if texts else []


class Lists:
    """Lists of ids, one after another."""

    def __init__(self):
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes, dtype=np.int64)])
        self.ids = np.concatenate([self.ids, ids])

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these lists, and their sizes."""
        starts, sizes = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        return self.ids[np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)], sizes

    def keep(self, rows: np.ndarray) -> None:
        ids, sizes = self.of(rows)
        self.__init__()
        self.add(ids, sizes)


def merged(a_ends: np.ndarray, a_stops: np.ndarray, b_ends: np.ndarray, b_stops: np.ndarray):
    """Links (places in A and in B) and cuts (last places of groups in A and in B) of all documents.

    ``a_ends`` and ``b_ends`` are the tokens' ends in the joined bytes of the documents; ``a_stops`` and
    ``b_stops`` are where each document's tokens stop.
    """
    full = np.flatnonzero(np.diff(a_stops, prepend=0))
    at_a, at_b = (np.concatenate([[0], s[:-1]]).astype(np.int32)[full] for s in (a_stops, b_stops))
    stop = a_stops[full].astype(np.int32)
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(at_a):
        links_a.append(at_a)
        links_b.append(at_b)
        end_a, end_b = a_ends[at_a], b_ends[at_b]
        cut = end_a == end_b
        cuts_a.append(at_a[cut])
        cuts_b.append(at_b[cut])
        at_a, at_b = at_a + (end_a <= end_b), at_b + (end_b <= end_a)
        going = at_a < stop
        if not going.all():
            at_a, at_b, stop = at_a[going], at_b[going], stop[going]
    none = [np.zeros(0, np.int32)]
    return tuple(np.concatenate(x or none) for x in (links_a, links_b, cuts_a, cuts_b))


def _written(a_groups: np.ndarray, b_groups: np.ndarray, a: np.ndarray, b: np.ndarray, tables: Tokenizers) -> np.ndarray:
    """The tokens of A and B in the order of the group strings, as places in ``digits``."""
    last_a = np.diff(a_groups, append=-1) != 0
    last_b = np.diff(b_groups, append=-1) != 0
    n_a, n_b = len(tables.a_bytes), len(tables.b_bytes)
    to_a = np.arange(len(a)) + np.searchsorted(b_groups, a_groups, "left")
    to_b = np.arange(len(b)) + np.searchsorted(a_groups, b_groups, "right")
    out = np.empty(len(a) + len(b), np.int32)
    out[to_a] = a + n_a * last_a
    out[to_b] = 2 * n_a + b + n_b * last_b
    return out


class Aligned:
    """A block of documents, merged: counts, group strings and the pairs that each document holds."""

    def __init__(self, texts: list[str | None], tables: Tokenizers):
        parts = [tables.flat(some) for some in _runs(texts, 1 << 20)]
        none = np.zeros(0, np.int32), np.zeros(0, np.int64)
        (a, n_a), (b, n_b) = (tuple(map(np.concatenate, zip(none, *(p[k] for p in parts)))) for k in (0, 1))
        sizes = n_a.astype(np.int64), n_b.astype(np.int64)
        a_stops, b_stops = (np.cumsum(s) for s in sizes)
        a_ends, b_ends = np.cumsum(tables.a_sizes[a]), np.cumsum(tables.b_sizes[b])
        links_a, links_b, cuts_a, cuts_b = merged(a_ends, a_stops, b_ends, b_stops)
        n = len(texts)
        owner = np.repeat(np.arange(n), sizes[0])
        links = np.bincount(owner[links_a], minlength=n)
        groups = np.bincount(owner[cuts_a], minlength=n)
        self.counts = dict(zip(COUNTS, (sizes[0], sizes[1], groups, links)))
        # a token's group is the number of cuts before it
        a_groups, b_groups = (np.cumsum(np.bincount(c + 1, minlength=len(x) + 1)[:len(x)])
                              for c, x in ((cuts_a, a), (cuts_b, b)))
        written = tables.digits[_written(a_groups, b_groups, a, b, tables)]
        shown = written > 0
        ends = np.cumsum(shown.sum(axis=1))
        ends = np.concatenate([[0], ends])[np.concatenate([[0], a_stops + b_stops])].tolist()
        data = written[shown].tobytes()
        self.strings = [data[i:j][:-1] for i, j in zip(ends, ends[1:])]
        keys = (a[links_a].astype(np.int64) << SHIFT) | b[links_b]
        self.keys, place = np.unique(keys, return_inverse=True)
        held, self.times = np.unique(owner[links_a] * max(1, len(self.keys)) + place, return_counts=True)
        self.doc, self.pair = np.divmod(held, max(1, len(self.keys)))
        self.documents = np.bincount(self.pair, minlength=len(self.keys))


def _runs(texts: list[str | None], most: int) -> Iterator[list[str | None]]:
    """Runs of texts of about ``most`` characters, one text at least."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _packed(values: np.ndarray) -> bytes:
    """Small integers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(values.astype(np.uint32)).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(3).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view(np.uint32)


def blocks(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """A row for each block of documents: their counts and digests, and the pairs that they hold.

    ``keys`` are the block's distinct pairs, ``documents`` how many of its documents hold each. ``entries``,
    ``pairs`` (gaps between places in ``keys``) and ``times`` list each document's pairs and links.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizers(byte_bpe, piece_bpe))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, number = shared.value.loaded(), TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in sliced(whole, "text", BLOCK):
                found = Aligned(batch.column("text").to_pylist(), tables)
                n = batch.num_rows
                entries = np.bincount(found.doc, minlength=n)
                first = np.concatenate([[0], np.cumsum(entries)[:-1]])[entries > 0]
                gaps = np.diff(found.pair, prepend=0)
                gaps[first] = found.pair[first]
                sha = [hashlib.sha256(s).hexdigest() if s else "" for s in found.strings]
                one = lambda x, kind: packed([x], kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.ListArray.from_arrays([0, n], batch.column("doc_id")),
                     *(one(found.counts[c], pa.int64()) for c in COUNTS),
                     pa.ListArray.from_arrays([0, n], pa.array(sha, pa.string())),
                     one(entries, pa.int64()), pa.array([_packed(gaps)], pa.binary()),
                     pa.array([_packed(found.times)], pa.binary()),
                     one(found.keys, pa.int64()), one(found.documents, pa.int64())],
                    ["block", "doc_id", *COUNTS, "groups_sha256", "entries", "pairs", "times", "keys", "documents"])
                number += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} array<long>" for c in COUNTS)
    return docs.select("doc_id", "text").mapInArrow(
        run, f"block long, doc_id array<{kind}>, {counts}, groups_sha256 array<string>, entries array<long>, "
             "pairs binary, times binary, keys array<long>, documents array<long>")


def pair_counts(packed_docs: DataFrame) -> DataFrame:
    """(key, n, best): how many documents hold each pair, and whether that is the most of its id of A."""
    rows = packed_docs.select(F.explode(F.arrays_zip("keys", "documents")).alias("x")).select("x.*")
    counts = materialize(rows.groupBy(F.col("keys").alias("key")).agg(F.sum("documents").alias("n")), "pair-counts")
    counts = counts.withColumn("a", F.shiftright("key", SHIFT))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A: at most the vocabulary
    return counts.join(F.broadcast(most), "a").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every document row."""
    held = materialize(blocks(docs, byte_bpe, piece_bpe), "aligned")
    counts = materialize(pair_counts(held), "pairs")
    asked = held.select(F.col("block").alias("in_block"), F.posexplode("keys").alias("place", "key"))
    answers = asked.join(counts, "key").select("in_block", "place", "n", "best")

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        if not block.num_rows:
            return empty
        row = {c: block.column(c).combine_chunks().flatten() for c in ("doc_id", *COUNTS, "groups_sha256", "entries")}
        entries = row["entries"].to_numpy()
        doc = np.repeat(np.arange(len(entries)), entries)
        gaps, times = (_unpacked(block.column(c)[0].as_py()).astype(np.int64) for c in ("pairs", "times"))
        first = np.cumsum(entries) - entries
        pair = np.cumsum(gaps)
        full = entries > 0
        pair -= np.repeat(pair[first[full]] - gaps[first[full]], entries[full])
        n, best = np.zeros((2, found.num_rows), np.int64)
        place = found.column("place").to_numpy()
        n[place] = found.column("n").to_numpy()
        best[place] = found.column("best").to_numpy()
        sums = []
        for values in (best, n):
            total = np.concatenate([[0], np.cumsum(values[pair] * times)])
            sums.append(pa.array(total[first + entries] - total[first], pa.int64()))
        return pa.Table.from_arrays(
            [row["doc_id"], *(row[c] for c in COUNTS), *sums, row["groups_sha256"]], empty.column_names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:-1]) + ", groups_sha256 string"
    empty = pa.table({c: [] for c in names})
    return held.drop("keys", "documents").groupBy("block").cogroup(answers.groupBy("in_block")).applyInArrow(run, schema)
