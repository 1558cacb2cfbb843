"""Language identification by prediction by partial matching.

Every language gets a tree of byte contexts up to three bytes deep, learned by counting. The code
length of a text under a tree is exact: a byte seen after the longest known context costs
``-log2(count / (total + distinct))``; otherwise the escape ``-log2(distinct / (total + distinct))``
is paid and the next shorter context is asked, down to eight bits for any byte (escape method C,
without exclusions). Statistics are frozen while scoring. The shortest code length names the
language; the score is that language's share of ``2 ** -bits`` over all languages.

The model is learned from labelled rows with all their grams. Of each language, rows are taken by a hash
of their text so that all languages together make up about ``FIT_BYTES`` bytes; with less, every row is
taken. So the model has at most about as many grams as that, however large the corpus is, which bounds
what is broadcast. Counting is distributed: each task counts four-byte grams, Spark adds them up.

Texts are lower-cased first. A null text or one without a letter (by ``str.isalpha``) is ``und`` with score 0, also when
nothing could be learned. Ties go to the smaller language name. Texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Index, buffers, materialize, sliced

ORDER = 3
PAD = 10  # a text starts after ORDER line feeds
FIT_BYTES = 32 << 20  # bytes of labelled texts to learn from
MAX_BITS = 8.0  # a text that costs more bits a byte than this is like none of the languages
SLICE = 1 << 20  # bytes of text that are counted or scored in one go


def _padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams ending at each place of the padded texts, row of each place, and whether it is text."""
    starts, data = buffers(texts)
    n = len(starts) - 1
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
    at = np.arange(len(data), dtype=np.int32) + ORDER * (row + 1)
    padded = np.full(len(data) + ORDER * n, PAD, np.uint32)
    padded[at] = data
    gram = padded.copy()
    for back in range(1, ORDER + 1):
        gram[back:] |= padded[:-back] << np.uint32(8 * back)
    return gram[at], row, data


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, list] = {}

    def settle(lang: str) -> None:
        grams = np.concatenate([g for g, _ in found[lang]])
        counts = np.concatenate([c for _, c in found[lang]])
        keys, inverse = np.unique(grams, return_inverse=True)
        found[lang] = [(keys, np.bincount(inverse, counts, len(keys)).astype(np.int64))]

    for whole in batches:
        for batch in sliced(whole, "text", SLICE):
            langs, texts = batch.column("lang"), pc.utf8_lower(batch.column("text"))
            for lang in pc.unique(langs).to_pylist():
                grams, _, _ = _padded(texts.filter(pc.equal(langs, lang)))
                found.setdefault(lang, []).append(np.unique(grams, return_counts=True))
                if len(found[lang]) > 8:
                    settle(lang)
    for lang in found:
        settle(lang)
        keys, counts = found[lang][0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)),
             pa.array(counts)], ["lang", "gram", "n"])


def fitting_rows(texts: DataFrame, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """The (text, lang) rows to learn from: about as many bytes of each language, by a hash of the text."""
    known = texts.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    totals = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("total"))  # one row a language
    share = totals.select("lang", F.try_divide(F.lit(fit_bytes / max(1, totals.count())), "total").alias("share"))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (known.join(F.broadcast(share), "lang").where(F.coalesce(place < F.col("share"), F.lit(True)))
            .select("lang", "text"))


def gram_counts(texts: DataFrame) -> DataFrame:
    """How often each four-byte gram occurs in each language: (lang, gram, n)."""
    return (texts.mapInArrow(_counted, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


@dataclass
class Model:
    """Frozen context trees: cost of each known gram and escape of each known context, by length."""

    langs: list[str]
    costs: dict[int, tuple[Index, np.ndarray]]
    escapes: dict[int, tuple[Index, np.ndarray]]

    def bits(self, grams: np.ndarray, length: int = ORDER + 1) -> np.ndarray:
        """Code length of each gram's last byte in every language."""
        if not length:
            return np.full((len(grams), len(self.langs)), 8, np.float32)
        index, cost = self.costs[length]
        place = index.find(grams)
        out = cost[place]
        missed = np.flatnonzero(place < 0)
        if len(missed):
            below = grams[missed] & np.uint32((1 << 8 * (length - 1)) - 1)
            index, escape = self.escapes[length]
            context = index.find(grams[missed] >> np.uint32(8))
            out[missed] = self.bits(below, length - 1) + np.where(
                context[:, None] >= 0, escape[context], np.float32(0))
        return out

    def code_lengths(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of every (lower-cased) text in every language, and its length in bytes."""
        grams, row, _ = _padded(texts)
        out = np.zeros((len(texts), len(self.langs)))
        for start in range(0, len(grams), SLICE):
            rows = row[start:start + SLICE]
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            bits = self.bits(grams[start:start + SLICE])
            out[rows[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.float64)
        return out, np.bincount(row, minlength=len(texts))


def build(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """Context trees from gram counts; ``lang`` holds places in ``langs``."""
    width = len(langs)
    keys, inverse = np.unique(gram.astype(np.uint32), return_inverse=True)
    counts = np.zeros((len(keys), width))
    np.add.at(counts, (inverse, lang), n)
    levels = {ORDER + 1: (keys, counts)}
    for length in range(ORDER, 0, -1):
        longer, counts = levels[length + 1]
        keys, inverse = np.unique(longer & np.uint32((1 << 8 * length) - 1), return_inverse=True)
        sums = np.zeros((len(keys), width))
        np.add.at(sums, inverse, counts)
        levels[length] = keys, sums
    below_keys, below = np.zeros(1, np.uint32), np.full((1, width), 8.0)
    costs, escapes = {}, {}
    for length in range(1, ORDER + 2):
        keys, counts = levels[length]
        contexts, inverse = np.unique(keys >> np.uint32(8), return_inverse=True)
        total, distinct = np.zeros((2, len(contexts), width))
        np.add.at(total, inverse, counts)
        np.add.at(distinct, inverse, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2((total + distinct) / distinct), 0.0)
            seen = np.log2((total + distinct)[inverse] / counts)
        shorter = np.searchsorted(below_keys, keys & np.uint32((1 << 8 * (length - 1)) - 1))
        cost = np.where(counts > 0, seen, escape[inverse] + below[shorter])
        costs[length] = Index(keys), cost.astype(np.float32)
        escapes[length] = Index(contexts), escape.astype(np.float32)
        below_keys, below = keys, cost
    return Model(langs, costs, escapes)


def train(texts: DataFrame, fit_bytes: int = FIT_BYTES) -> Model | None:
    """Learn from the rows of (text, lang) with both; None if there is nothing to learn from."""
    rows = materialize(fitting_rows(texts, fit_bytes), "fitting")
    counts = gram_counts(rows).toPandas()  # at most a row for each byte that is learned from
    if not len(counts):
        return None
    langs = sorted(counts["lang"].unique())
    place = {lang: i for i, lang in enumerate(langs)}
    return build(langs, counts["lang"].map(place).to_numpy(), counts["gram"].to_numpy(),
                 counts["n"].to_numpy())


def judged(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits a byte of each text."""
    spoken = np.array([any(map(str.isalpha, t or "")) for t in texts.to_pylist()], bool)
    if model is None or not len(texts):
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    bits, size = model.code_lengths(pc.utf8_lower(texts))
    best = bits.argmin(axis=1)
    gap = bits - bits.min(axis=1, keepdims=True)
    score = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
    langs = [model.langs[b] if s else "und" for b, s in zip(best, spoken)]
    return langs, np.where(spoken, score, 0.0), bits.min(axis=1) / np.maximum(size, 1)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                langs, score, bits = judged(shared.value, batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score),
                     pa.array(bits)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, model: Model | None, max_bits: float = MAX_BITS) -> DataFrame:
    """The documents, all columns, whose language is found at no more than ``max_bits`` a byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                langs, _, bits = judged(shared.value, batch.column("text"))
                keep = np.array([x != "und" for x in langs], bool) & (bits <= max_bits)
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)

