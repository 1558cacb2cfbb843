"""Quality scores, segmentation and the whole pipeline against plain versions of their definitions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from conftest import SF
from rolecall.llm import quality, spm
from rolecall.llm.queries import QUERIES
from test_copies import plain_edits, plain_groups
from test_models import plain_bits


def share(part, whole):
    p = (part + 0.5) / (whole + 1)
    return math.log(p / (1 - p))


def plain_statistics(text):
    data = (text or "").encode()
    words, lines = data.split(), data.split(b"\n")
    upper, lower = (sum(a <= c <= z for c in data) for a, z in ((65, 90), (97, 122)))
    digits, high = sum(48 <= c <= 57 for c in data), sum(c > 127 for c in data)
    marks, bangs, bars = sum(chr(c) in ".,;:'\"-()?" for c in data), data.count(b"!"), data.count(b"|")
    symbols = len(data) - upper - lower - digits - high - marks - bangs - bars - sum(c in b"\t\n\v\f\r " for c in data)
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    often = Counter(words)
    return [
        math.log1p(len(data)), math.log1p(len(words)), share(upper, upper + lower), share(digits, len(data)), share(marks, len(data)),
        share(bangs, len(data)), share(bars, len(data)), share(symbols, len(data)), share(high, len(data)), math.log1p(mean),
        math.log1p(sum((s - mean) ** 2 for s in sizes) / len(sizes)), share(len(often), len(words)),
        share(sum(a == b for a, b in zip(words, words[1:])), len(words)), share(max(often.values(), default=0), len(words)),
        math.log1p(len(lines)), share(len(set(lines)), len(lines))]


@pytest.mark.parametrize("text", [None, "", " ", "a", "A b! c|d\n\nA b! 12 é$ ", "x y x y\tz", "1\n1\n2"])
def test_statistics(text):
    np.testing.assert_allclose(quality.statistics((text or "").encode()), plain_statistics(text), rtol=1e-12)


def test_quality_scores(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    stats = {i: np.array(plain_statistics(t)) for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    classes = [np.array([stats[i] for i, q in labels if q == k and i in stats and not held[i]]) for k in (0, 1)]
    n = [len(c) for c in classes]
    own = [np.cov(c.T, bias=True) for c in classes]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    logs = []
    for k, c in enumerate(classes):
        mixed = 0.95 * (0.9 * own[k] + 0.1 * pooled) + 0.05 * np.diag(np.maximum(np.diag(pooled), 1e-6))
        inverse, (_, log_det) = np.linalg.inv(mixed), np.linalg.slogdet(mixed)
        logs.append({i: -0.5 * (s - c.mean(axis=0)) @ inverse @ (s - c.mean(axis=0)) - 0.5 * log_det + math.log(n[k]) for i, s in stats.items()})
    got = {r["doc_id"]: r for r in QUERIES["op4_quality"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, row in got.items():
        wanted = 1 / (1 + math.exp(-max(-700, min(700, logs[1][i] - logs[0][i]))))
        assert row["score"] == pytest.approx(wanted, abs=1e-6) and row["held_out"] == held[i]
        assert row["predicted"] == (row["score"] >= 0.3)


def best_by_trying(vocabulary, text):
    """The highest score of any way to cut a text into pieces, or characters spelled in bytes."""
    pieces = {s: vocabulary.scores[i] for i, s in enumerate(vocabulary.surfaces) if s and i >= 256}
    best = {0: 0.0}
    starts = [i for i in range(len(text) + 1) if i == len(text) or text[i] & 0xC0 != 0x80]
    for i, start in enumerate(starts):
        if start in best:
            for end in starts[i + 1:]:
                part = text[start:end]
                score = pieces.get(part, vocabulary.unknown if end == starts[i + 1] else None)
                if score is not None:
                    best[end] = max(best.get(end, -math.inf), best[start] + score)
    return best[len(text)]


def test_segmentation():
    rng = random.Random(7)
    surfaces = [bytes([i]) for i in range(256)]
    surfaces += sorted({"".join(rng.choices("abé日", k=rng.randint(1, 4))).encode() for _ in range(60)}) + [b" ", b" a", b" ab"]
    scores = np.array([-50.0] * 256 + [-rng.uniform(1, 9) for _ in surfaces[256:]])
    vocabulary = spm.Vocabulary(surfaces, scores, np.arange(256))
    texts = ["".join(rng.choices("abécd日 ", k=rng.randint(0, 12))).encode() for _ in range(400)] + [("ab" * 40 + "x").encode()]
    for text, ids in zip(texts, vocabulary.encode(texts)):
        assert b"".join(surfaces[i] for i in ids) == (b" " + text if text else b"")
        got, k = 0.0, 0
        ids = ids.tolist()
        while k < len(ids):  # a run of bytes that spells one character counts once
            if ids[k] < 256:
                lead = ids[k]
                k += 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
                got += vocabulary.unknown
            else:
                got += scores[ids[k]]
                k += 1
        assert got == pytest.approx(best_by_trying(vocabulary, b" " + text) if text else 0.0)


def corpus():
    rng = random.Random(5)
    common = "the cat and dog of house tree over under".split()
    foreign = "der hund und katze von haus baum oben unter".split()
    text = lambda words, n: " ".join(rng.choice(words) + str(rng.randint(0, 400)) * (rng.random() < 0.7) for _ in range(n))
    items = [(i, text(common, 20)) for i in range(6)]
    passage = text(common, 60)
    rows = []
    for i in range(40):
        words, lang = (common, "en") if i % 2 else (foreign, "de")
        body = text(words, rng.randint(20, 90))
        if i % 5 == 0:
            body += " " + passage + " " + text(words, 5)
        if i % 7 == 0:
            leak = items[i % 6][1].split()
            leak[rng.randrange(20)] = "other"
            body += " " + " ".join(leak)
        rows.append((i, body, lang if i % 4 else None))
    rows += [(100 + i, rows[i][1] + " one more" * (i % 2), rows[i][2]) for i in range(10)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "12 34 ²", "en"), (203, "字" * 50, "en"), (204, rows[3][1], "en"), (None, "the cat", "en"),
             (205, text(common, 30) + " ▁ x", "en"), (3, rows[3][1], "en"), (4, "the house under " + text(common, 10), "en")]
    return rows, items


def plain_pipeline(rows, items):
    """The (doc_id, text) that are left, stage by stage, by the definitions."""
    learned = [(lang, t) for i, t, lang in rows if i is not None and lang is not None and t is not None and zlib.crc32(str(i).encode()) % 5]
    langs = sorted({lang for lang, _ in learned})
    docs = [(i, t) for i, t, _ in rows if t and any(map(str.isalpha, t)) and min(
        plain_bits(learned, lang, t) for lang in langs) <= 8 * len(t.lower().encode())]
    known = list(dict.fromkeys((i, t) for i, t in docs if i is not None))
    numbered = [(i * 1000 + k, t) for k, (i, t) in enumerate(known)]  # rows of one id with other texts are documents
    groups = defaultdict(list)
    for n, _, label in plain_groups(numbered, 5, 80):
        groups[label].append(n)
    kept = {min(g) for g in groups.values()}
    docs = [(n // 1000, t) for n, t in numbered if n in kept] + [(i, t) for i, t in docs if i is None]
    first, out = defaultdict(lambda: math.inf), []
    for i, t in docs:
        words = t.split()
        for k in range(len(words) - 49 if i is not None else 0):
            first[tuple(words[k:k + 50])] = min(first[tuple(words[k:k + 50])], i)
    for i, t in docs:
        words = t.split()
        gone = {p for k in range(len(words) - 49) if i is not None and first[tuple(words[k:k + 50])] < i for p in range(k, k + 50)}
        if not gone:
            out.append((i, t))
        elif len(gone) < len(words):
            out.append((i, " ".join(w for k, w in enumerate(words) if k not in gone)))
    return [(i, t) for i, t in out if not any(plain_edits(item, t)[0] <= 0.2 * plain_edits(item, t)[1] for _, item in items)]


def test_pipeline(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    wanted = plain_pipeline(rows, items)
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(wanted, key=str)
    assert 15 < len(wanted) < len(rows) - 10
    assert all(r["decoded"] == r["text"] and r["n_chars"] == len(r["text"]) and r["piece_ids"] for r in got)
