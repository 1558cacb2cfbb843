"""Texts searched as whole Arrow columns, by an engine of linear time.

Only what means the same here as in ``patterns`` is looked for this way; ``scannable`` tells.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import literal_runs

_SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORD = r"\p{L}\p{N}_"
# Characters beyond ASCII that are an ASCII letter when case is ignored.
_LETTERS = {"İ": "i", "ı": "i", "ſ": "s", "K": "k"}
# Literals, any character, choices, groups and plain repeats.
_SIMPLE = re.compile(r"(?:[A-Za-z0-9 _,;:'\"@#%&=<>~`!/-]|\\[^A-Za-z0-9]|[.?*+|)]|\((?!\?)|\(\?:)+")
_EDGED = re.compile(r"\\b([A-Za-z0-9_](?:[A-Za-z0-9_ -]*[A-Za-z0-9_])?)\\b")


def folded(texts: pa.Array, slashes: bool = True) -> pa.Array:
    """The texts with ASCII letters, and what matches them in any case, in lower case; slashes stay or are blanks."""
    texts = texts.cast(pa.large_string())
    validity, offsets, data = texts.buffers()
    low = (data.to_pybytes() if data else b"").lower()
    if not slashes:
        low = low.replace(b"/", b" ")
    out = pa.Array.from_buffers(
        pa.large_string(), len(texts), [validity, offsets, pa.py_buffer(low)], texts.null_count, texts.offset)
    for letter, plain in _LETTERS.items():
        if letter.encode() in low:
            out = pc.replace_substring(out, letter, plain)
    return out


def _quoted(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_ \x00-\x1f\x7f]", r"\\\g<0>", text)


def _whole(inner: str) -> str:
    return f"(?:^|[^{_WORD}])(?:{inner})(?:[^{_WORD}]|$)"


def whole_words(spellings: Sequence[str]) -> str:
    """A pattern of spellings with no word character around."""
    return _whole("|".join(spellings).replace(r"\s", f"[{_SPACE}]").replace(r"\w", f"[{_WORD}]"))


def matching(texts: pa.Array, pattern: str) -> np.ndarray:
    """Whether each text holds the pattern; null texts do not."""
    found = pc.fill_null(pc.match_substring_regex(texts, pattern), False)
    return found.to_numpy(zero_copy_only=False)


def scannable(pattern: str) -> tuple[str, str | None] | None:
    """A text that folded texts must hold, and the pattern to confirm if that is not all; ``None`` if it has to be
    left to the JVM."""
    if not pattern.isascii():
        return None
    runs = literal_runs(pattern)
    if runs is not None and len(runs) == 1:
        return _quoted(runs[0].lower()), None
    edged = _EDGED.fullmatch(pattern)
    if edged:
        return _quoted(edged[1].lower()), _whole(_quoted(edged[1].lower()))
    bare = re.sub(r"\\.", "", pattern)
    if bare != bare.lower() or not _SIMPLE.fullmatch(pattern) or re.search(r"(?<!\\)[?*+]\+", pattern):
        return None
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid:
        return None
    return _quoted(max(runs, key=len).lower()) if runs else "", pattern


def _holding(texts: pa.Array, needed: str, pattern: str | None) -> np.ndarray:
    found = matching(texts, needed)
    if pattern is not None and found.any():
        some = np.flatnonzero(found)
        found[some] = matching(texts.take(pa.array(some)), pattern)
    return found


def as_lists(rows: np.ndarray, values: np.ndarray, size: int) -> pa.ListArray:
    """One list for each of ``size`` rows, of values given with their ascending rows."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=size))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def found_places(columns: Sequence[Column], searches: Sequence[tuple[int, tuple[str, str | None]]]) -> Column:
    """Places, ascending, of the ``scannable`` patterns (place, what to look for) that any of the texts holds."""
    searches = sorted(searches)
    places = np.array([place for place, _ in searches], np.int32)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [folded(t) for t in batch.flatten()]
            held = np.zeros((len(batch), len(searches)), bool)
            for i, (_, search) in enumerate(searches):
                for t in texts:
                    held[:, i] |= _holding(t, *search)
            rows, which = np.nonzero(held)
            yield as_lists(rows, places[which], len(batch))

    return _once(run, "array<int>")(_struct(columns))


def _struct(columns: Sequence[Column]) -> Column:
    return F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns)))


def _once(run, kind: str):
    """A function that is neither pushed below nor repeated above where it is called."""
    return F.arrow_udf(run, kind).asNondeterministic()


class TermIndex:
    """Plain terms by their first eight bytes; all their occurrences in a buffer are found in one pass."""

    STEP = 1 << 20

    def __init__(self, terms: Sequence[bytes]):
        self.lengths = np.array([len(t) for t in terms], np.int64)
        self.blocks = max(1, -(-int(self.lengths.max(initial=1)) // 8))
        joined = b"".join(t.ljust(8 * self.blocks, b"\0") for t in terms)
        self.words = np.frombuffer(joined, "<u8").reshape(len(terms), self.blocks)
        self.opens = np.zeros(1 << 20, bool)  # hashes of the first four bytes
        self.groups = []
        heads = np.minimum(self.lengths, 8)
        for size in np.unique(heads).tolist():
            members = np.flatnonzero(heads == size)
            members = members[np.argsort(self.words[members, 0], kind="stable")]
            keys, first, counts = np.unique(self.words[members, 0], return_index=True, return_counts=True)
            known = np.zeros(1 << 20, bool)
            known[self._hash(keys)] = True
            self.groups.append((size, np.uint64((1 << 8 * size) - 1), members, keys, first, counts, known))
            if size >= 4:
                self.opens[self._short(keys.astype(np.uint32))] = True

    @staticmethod
    def _short(heads: np.ndarray) -> np.ndarray:
        return (heads * np.uint32(2654435761)) >> np.uint32(12)

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def _in(self, at: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, term) where a term may start, compared in full."""
        near = at[self.opens[self._short(words[at].astype(np.uint32))]]
        for size, mask, members, keys, first, counts, known in self.groups:
            where = near if size >= 4 else at
            heads = words[where] & mask
            some = np.flatnonzero(known[self._hash(heads)])
            where, heads = where[some], heads[some]
            slot = np.minimum(np.searchsorted(keys, heads), len(keys) - 1)
            fits = keys[slot] == heads
            where, slot = where[fits], slot[fits]
            many = counts[slot]
            ranks = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            where, terms = np.repeat(where, many), members[np.repeat(first[slot], many) + ranks]
            for block in range(1, self.blocks if size == 8 else 1):
                rest = np.clip(self.lengths[terms] - 8 * block, 0, 8).astype(np.uint64)
                # no shift by all 64 bits
                kept = np.where(rest == 0, np.uint64(0), ~np.uint64(0) >> (np.uint64(8) * (np.uint64(8) - np.maximum(rest, np.uint64(1)))))
                here = words[np.minimum(where + 8 * block, len(words) - 1)]
                same = (here & kept) == self.words[terms, block]
                where, terms = where[same], terms[same]
            yield where, terms

    def held(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, term), each once and ascending, of a large_string array."""
        if not len(texts) or not len(self.lengths):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        body = memoryview(data)[ends[0]:ends[-1]] if data else b""
        ends = ends - ends[0]
        padded = bytes(body) + bytes(16)
        words = np.ndarray((len(padded) - 8,), "<u8", padded, strides=(1,))
        some = texts.is_valid().to_numpy(zero_copy_only=False)
        codes = [np.zeros(0, np.int64)]
        for start in range(0, int(ends[-1]), self.STEP):
            for where, terms in self._in(np.arange(start, min(start + self.STEP, int(ends[-1]))), words):
                rows = np.searchsorted(ends, where, "right") - 1
                inside = (where + self.lengths[terms] <= ends[rows + 1]) & some[rows]
                codes.append(np.unique(rows[inside] * len(self.lengths) + terms[inside]))
        return np.divmod(np.unique(np.concatenate(codes)), len(self.lengths))


def held_terms(columns: Sequence[Column], terms: Sequence[str], places: Sequence[int]) -> Column:
    """Places of the plain folded ASCII terms that any of the texts holds, each once; ``places`` ascend."""
    places = np.array(places, np.int32)
    plain = [t.encode() for t in terms]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = TermIndex(plain)
        for batch in batches:
            codes = []
            for texts in batch.flatten():
                rows, which = index.held(folded(texts))
                codes.append(rows * len(plain) + which)
            rows, which = np.divmod(np.unique(np.concatenate(codes)), max(len(plain), 1))
            yield as_lists(rows, places[which], len(batch))

    return _once(run, "array<int>")(_struct(columns))


def mentions(text: Column, spellings: Sequence[str]) -> Column:
    """Whether a folded text has one of the spellings as whole words; null texts have not."""
    pattern = whole_words(spellings)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(matching(texts, pattern))

    return _once(run, "boolean")(text)


def fold_slashless(text: Column) -> Column:
    """Folded text with blanks for slashes."""
    def run(texts: pa.Array) -> pa.Array:
        return folded(texts, slashes=False).cast(texts.type)

    return F.arrow_udf(run, "string")(text)


def named_scores(places: Column, names: Sequence[str], weights: Sequence[int]) -> Column:
    """``struct<score, keywords>``: the sum of the weights at the places, and the names."""
    known, weighed = list(names), np.array(weights, np.int64)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = pa.array(known, pa.string())
        for batch in batches:
            at, ends = batch.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(batch).to_numpy(zero_copy_only=False))])
            sums = np.concatenate([[0], np.cumsum(weighed[at.to_numpy(zero_copy_only=False)])])
            yield pa.StructArray.from_arrays(
                [pa.array((sums[ends[1:]] - sums[ends[:-1]]).astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.take(at))], ["score", "keywords"])

    return _once(run, "struct<score:int,keywords:array<string>>")(places)
