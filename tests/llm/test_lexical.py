"""Ranked lexical search against plain scoring of all pairs, and the bounds of the trees."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rolecall.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=10):
    """(item_id, rank, doc_id, score), every document scored for every item."""
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    full = [b for _, b in bags if b]
    n_docs, n_terms = len(full), sum(sum(b.values()) for b in full)
    df = Counter(t for b in full for t in b)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, its in wanted.items():
        scored = []
        for i, bag in bags:
            if bag and i is not None:
                m = 10 + 90 * sum(bag.values()) * n_docs // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                            * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in its if t in bag)
                if score > 0:
                    scored.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def corpus(seed, n, m):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 4))) for _ in range(300)]
    text = lambda k: " ".join(words[min(299, int(draw.paretovariate(0.6)))] for _ in range(k))
    items = [(i, text(draw.randint(1, 30))) for i in range(m)]
    docs = [(i, text(draw.randint(0, 80)) + draw.choice(["", ". ", " " + draw.choice(items)[1]])) for i in range(n)]
    return docs, items


ODD_DOCS = [(1, None), (2, ""), (3, "--- ... !"), (4, "Über die Straße ÜBER"), (5, "a_b c-d e1f2"), (5, "a_b c-d e1f2"),
            (None, "über cat"), (6, "cat cat cat hat"), (7, "cat hat"), (8, "cat hat"), (9, "x" * 100_000), (10, "日本語 cat hat"),
            (11, "word " * 50_000 + "rare")]
ODD_ITEMS = [(1, "CAT hat"), (2, None), (3, "..."), (None, "cat"), (4, "über straße"), (5, "a b"), (5, "c"), (6, "nowhere"),
             (7, "cat HAT cat"), (8, "x" * 100_000), (9, "rare word")]


def result(spark, docs, items, k=10):
    docs = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, rank int, ids int").repartition(5)
    items = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    return sorted(tuple(r) for r in lexical.search(docs, items, k).collect())


@pytest.mark.parametrize("seed, n, m, k", [(1, 400, 60, 10), (2, 2500, 5, 3), (3, 90, 700, 10), (4, 20, 3, 50)])
def test_search_matches_plain_scoring(spark, seed, n, m, k, monkeypatch):
    docs, items = corpus(seed, n, m)
    assert result(spark, docs, items, k) == plain(docs, items, k)


def test_odd_rows(spark):
    assert result(spark, ODD_DOCS, ODD_ITEMS) == plain(ODD_DOCS, ODD_ITEMS)


def test_equal_scores_rank_by_id(spark):
    docs = [(i, "same words here") for i in range(500, 0, -1)] + [(1000, "other")]
    got = result(spark, docs, [(1, "words")])
    assert [r[2] for r in got] == list(range(1, 11)) and got == plain(docs, [(1, "words")])


def test_several_passes_and_empty_tables(spark, monkeypatch):
    docs, items = corpus(5, 200, 30)
    monkeypatch.setattr(lexical, "MOST_BYTES", 500)
    assert result(spark, docs, items) == plain(docs, items)
    assert result(spark, [], items) == [] and result(spark, docs, []) == []
    assert result(spark, [(1, None)], items) == []


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(1)  # ten topics of twenty terms
    items = [(i, np.unique(draw.integers(0, 20, 8)) + 20 * (i % 10)) for i in range(50)]
    tree = lexical.ItemTree(items, draw.integers(1, 9000, 200).astype(float))
    entries = np.unique([d * 200 + 20 * (d % 10) + t for d in range(600) for t in draw.integers(0, 20, 15)]
                        + [d * 200 + t for d in range(600) for t in draw.integers(0, 200, 3)])
    owner, term = np.divmod(entries, 200)
    rank = np.empty(600, np.int64)
    rank[lexical.tree_order(owner, term, 600, lexical.LEAF)] = np.arange(600)
    block = lexical.Documents(np.arange(600), rank[owner], term, draw.integers(1, 10**6, len(term)), tree)
    every = np.arange(len(block.levels[-1]))
    scores = {}
    for item in range(50):
        at, found = block.scores(tree, item, every)
        for a, s in zip(at.tolist(), found.tolist()):
            scores[item, a] = s
    kth = np.array([sorted((s for (i, _), s in scores.items() if i == item), reverse=True)[9] for item in range(50)], float)
    items_left, leaves = block.alive(tree, tree.weakest(kth))
    left = set(zip(items_left.tolist(), leaves.tolist()))
    assert {(i, a // lexical.LEAF) for (i, a), s in scores.items() if s >= kth[i]} <= left
    assert len(left) < 50 * len(every) * 0.5
