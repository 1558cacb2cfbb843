"""Language identification, quality scores and n-gram scores against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF
from rolecall.llm import langid, ngrams, quality, wordgrams
from rolecall.llm.common import held_out, table
from rolecall.llm.queries import QUERIES

TEXTS = [("en", "the cat and the hat"), ("en", "that is the other thing"), ("de", "der Hund und die Katze"),
         ("de", "das ist der andere über"), ("en", ""), (None, "the the"), ("de", None)]
ODD = ["the hat", "DER HUND", "", None, "12 34 !?", "日本語 text", "x", "über " * 3000]


def plain_bits(texts, lang, text):
    """Code length by the definition, one byte at a time."""
    seen = defaultdict(Counter)
    for tag, t in texts:
        if tag != lang or t is None:
            continue
        data = b"\n\n\n" + t.lower().encode()
        for i in range(3, len(data)):
            for n in range(4):
                seen[data[i - n:i]][data[i]] += 1
    data, bits = b"\n\n\n" + text.lower().encode(), 0.0
    for i in range(3, len(data)):
        for n in (3, 2, 1, 0, None):
            if n is None:
                bits += 8
                break
            counts = seen.get(data[i - n:i])
            if counts:
                total = sum(counts.values()) + len(counts)
                if counts[data[i]]:
                    bits += -math.log2(counts[data[i]] / total)
                    break
                bits += -math.log2(len(counts) / total)
    return bits


def test_code_lengths_are_exact(spark):
    model = langid.train(spark.createDataFrame(TEXTS, "lang string, text string"))
    assert model.langs == ["de", "en"]
    texts = [t for t in ODD if t]
    bits, _ = model.code_lengths(pa.array([t.lower() for t in texts]))
    wanted = [[plain_bits(TEXTS, lang, t) for lang in ("de", "en")] for t in texts]
    np.testing.assert_allclose(bits, wanted, rtol=1e-5)


def test_language_of_odd_rows(spark):
    model = langid.train(spark.createDataFrame(TEXTS, "lang string, text string"))
    docs = spark.createDataFrame([*enumerate(ODD), (None, "the hat"), (0, "the hat")], "doc_id long, text string")
    got = {(r["doc_id"], r["text"]): r for r in langid.identify(docs, model).join(docs, "doc_id").collect()}
    assert got[0, "the hat"]["lang_pred"] == "en" and got[1, "DER HUND"]["lang_pred"] == "de"
    for i in (2, 3, 4):
        assert (got[i, ODD[i]]["lang_pred"], got[i, ODD[i]]["score"]) == ("und", 0.0)
    assert langid.identify(docs, model).count() == len(ODD) + 2
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_letters_are_letters_only(spark):
    model = langid.train(spark.createDataFrame(TEXTS, "lang string, text string"))
    signs = ["²", "½", "①", "Ⅷ", "١٢", "_", "\u0301", "🙂", "ª", "ʰ", "ǅ", "字"]
    docs = spark.createDataFrame([*enumerate(signs)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert [got[i] == "und" for i in range(len(signs))] == [not s.isalpha() for s in signs] == [True] * 8 + [False] * 4


def test_what_is_learned_from_is_bounded(spark):
    rows = [("en", f"the cat {i} and the hat") for i in range(400)] + [("de", f"der Hund {i} und die Katze") for i in range(4000)]
    texts = spark.createDataFrame([*rows, ("xx", None), (None, "x"), ("yy", "")], "lang string, text string")
    taken = {r["lang"]: r["sum"] for r in langid.fitting_rows(texts, 30_000).groupBy("lang").agg(
        F.sum(F.octet_length("text")).alias("sum")).collect()}
    assert taken["en"] == sum(len(t) for x, t in rows if x == "en") and taken["yy"] == 0 and set(taken) == {"en", "de", "yy"}
    assert 5_000 < taken["de"] < 15_000  # a third of the bound for each language
    assert langid.fitting_rows(texts).count() == len(rows) + 1


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert langid.train(none) is None
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert langid.identify(docs, None).first()["lang_pred"] == "und"
    assert langid.identify(docs.where("false"), None).count() == 0
    assert langid.keep_identified(docs, None).count() == 0


def test_filter_keeps_all_columns(spark):
    model = langid.train(spark.createDataFrame(TEXTS, "lang string, text string"))
    docs = spark.createDataFrame([(1, "the hat", 5, "a"), (2, "7", 6, "b"), (3, None, 7, None)],
                                 "doc_id long, text string, score int, lang_pred string")
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "the hat", 5, "a")]


def test_language_held_out_accuracy(spark):
    docs = table(spark, SF.replace("0.001", "0.01"), "documents").select("doc_id", "lang")
    rows = QUERIES["op9_language"](spark, SF.replace("0.001", "0.01")).join(docs, "doc_id").where("held_out")
    assert rows.where("lang = lang_pred").count() >= 0.97 * rows.count() > 50


def test_scores_follow_the_densities():
    rng = np.random.default_rng(3)
    width = len(quality.NAMES)
    classes = [rng.normal(k, 1 + k, (400, width)) @ rng.normal(0, 1, (width, width)) for k in (0, 1)]
    model = quality.solve(np.array([400.0, 400.0]), np.array([c.sum(axis=0) for c in classes]),
                          np.array([c.T @ c for c in classes]))
    covariances = [np.cov(c.T, bias=True) for c in classes]
    pooled = sum(covariances) / 2
    density = []
    points = np.vstack([c[:20] for c in classes])
    for c, own in zip(classes, covariances):
        mixed = 0.9 * own + 0.1 * pooled
        mixed = 0.95 * mixed + 0.05 * np.diag(np.diag(pooled))
        gap = points - c.mean(axis=0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(mixed), gap)
                       - 0.5 * np.linalg.slogdet(mixed)[1])
    wanted = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -700, 700)))
    np.testing.assert_allclose(model.score(points), wanted, atol=1e-6)


def test_quality_held_out_accuracy(spark):
    folder = SF.replace("0.001", "0.01")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    rows = QUERIES["op4_quality"](spark, folder).join(labels, "doc_id").where("held_out")
    right = rows.where("predicted = quality").count()
    assert right >= 0.9 * rows.count() > 30


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "x " * 50_000)],
                                 "doc_id long, text string")
    measured = quality.measure(docs)
    for labels in ([], [(1, 1)], [(1, 0), (2, 0)], [(1, None), (3, 1), (3, 1), (2, 0), (9, 1)]):
        model = quality.fit(measured, spark.createDataFrame(labels, "doc_id long, label int"))
        scores = [r["score"] for r in quality.scored(measured, model).collect()]
        assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    assert quality.scored(measured.where("false"), model).count() == 0


def test_held_out_fold(spark):
    rows = spark.createDataFrame([(0,), (4,), (None,)], "doc_id long").select("doc_id", held_out().alias("h"))
    got = {r["doc_id"]: r["h"] for r in rows.collect()}
    import zlib
    assert got == {0: zlib.crc32(b"0") % 5 == 0, 4: zlib.crc32(b"4") % 5 == 0, None: True}


def plain_scores(texts, order, alpha, least):
    counts, total = Counter(), 0
    for t in texts:
        data = (t or "").encode()
        total += len(data)
        counts.update(data[i - n + 1:i + 1] for i in range(len(data)) for n in range(1, order + 1) if n <= i + 1)
    out = []
    for t in texts:
        data, logs = (t or "").encode(), []
        for i in range(len(data)):
            longest = min(order, i + 1)
            for n in range(longest, 0, -1):
                gram = data[i - n + 1:i + 1]
                if n == 1 or counts[gram] >= least:
                    below = counts[gram[:-1]] if n > 1 else total
                    logs.append(math.log(counts[gram] / below) + (longest - n) * math.log(alpha))
                    break
        out.append((len(data), sum(logs) / len(logs) if logs else None))
    return out


@pytest.mark.parametrize("order", [1, 2, 5])
def test_stupid_backoff(spark, order, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK_BYTES", 200)  # many blocks
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "cat", "é", "ran"]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [None, "", "q", "same words", "same words", "long " * 300]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r["doc_id"]: (r["n_bytes"], r["score"]) for r in ngrams.score(docs.repartition(3), order).collect()}
    for i, (size, score) in enumerate(plain_scores(texts, order, ngrams.ALPHA, ngrams.MIN_COUNT)):
        assert got[i][0] == size
        assert got[i][1] == (None if score is None else pytest.approx(score, abs=1e-9))
    assert ngrams.score(docs.where(F.lit(False)), order).count() == 0


def plain_word_scores(texts, order, alpha):
    grams = lambda ws, n: [tuple(ws[i - n + 1:i + 1]) for i in range(n - 1, len(ws))]
    split = [(t or "").encode().split() for t in texts]
    counts = Counter(g for ws in split for n in range(1, order + 1) for g in grams(ws, n))
    total, out = sum(map(len, split)), []
    for ws in split:
        own, logs = Counter(g for n in range(1, order + 1) for g in grams(ws, n)), []
        for i in range(len(ws)):
            longest = min(order, i + 1)
            for n in range(longest, 0, -1):
                gram = tuple(ws[i - n + 1:i + 1])
                k = counts[gram] - own[gram]
                if n == 1:
                    k, below = k + 1, total - len(ws) + 1
                else:
                    below = counts[gram[:-1]] - own[gram[:-1]]
                if k:
                    logs.append(math.log(k / below) + (longest - n) * math.log(alpha))
                    break
        out.append((len(ws), sum(logs) / len(logs) if logs else None))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_word_backoff(spark, order, monkeypatch):
    monkeypatch.setattr(wordgrams, "BLOCK_BYTES", 200)  # many blocks
    monkeypatch.setattr(wordgrams, "PART_BYTES", 300)  # many parts
    rng = random.Random(5)
    texts = ["\t".join(rng.choice(["the", "cat", "é", "ran"]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [None, "", " \n ", "q", "same words", "same words", "long " * 300]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r["doc_id"]: (r["n_words"], r["score"]) for r in wordgrams.score(docs.repartition(3), order).collect()}
    for i, (size, score) in enumerate(plain_word_scores(texts, order, wordgrams.ALPHA)):
        assert got[i] == (size, None if score is None else pytest.approx(score, abs=1e-9))
    assert wordgrams.score(docs.where(F.lit(False)), order).count() == 0


def test_known_words_in_random_order_score_below_prose(spark):
    rng = random.Random(6)
    follows = {i: rng.sample(range(300), 3) for i in range(300)}
    texts = []
    for _ in range(60):
        at = [rng.randrange(300)]
        while len(at) < 80:
            at.append(rng.choice(follows[at[-1]]))
        texts.append([f"word{i}" for i in at])
    mixed = rng.sample(texts[0], 80)
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, mixed])]
    got = {r["doc_id"]: r["score"] for r in wordgrams.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[60] < min(got[i] for i in range(60)) - 1
