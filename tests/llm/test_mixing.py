"""Mixing by hash thresholds against sorting, and what the mixes keep to."""

import math
from collections import Counter, defaultdict
from hashlib import md5

import pytest

from rolecall.llm import mixing


def plain(rows, share=1.0, weights=(1, 2, 3), most=3):
    """(doc_id, size, source_size, target, copies) of (doc_id, text, source) rows, by sorting."""
    sized = [(i, s, len((t or "").split()), md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15])
             for i, t, s in rows]
    sources = sorted({s for _, s, _, _ in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n, _ in sized if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    left, full = int(share * sum(size.values())), set()
    while True:
        rest, parts = left - sum(most * size[s] for s in full), sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and most * size[s] * parts < weight[s] * rest}
        if not more:
            break
        full |= more
    target = {s: float(most * size[s]) if s in full else weight[s] * rest / parts for s in sources}
    copies = {}
    for s in sources:
        whole = math.floor(target[s] / size[s]) if size[s] else 0
        rest, groups = target[s] - whole * size[s], defaultdict(int)
        for _, x, n, h in sized:
            if x == s:
                groups[h] += n
        before = 0
        for h in sorted(groups):
            copies[s, h] = whole + (groups[h] > 0 and 2 * (rest - before) >= groups[h])
            before += groups[h]
    return Counter((i, n, size[s], target[s], copies[s, h] if n else 0) for i, s, n, h in sized)


def rows(n=900):
    out = [(i, "w " * (1 + i * i % 37), f"s{i % 7}" if i % 3 else "hot") for i in range(n)]
    out += [(n + i, "w " * 40, None) for i in range(20)] + [(None, "no id " * 3, "s1"), (None, "no id", "s1")]
    return out + [(5000, "twice over " * 9, "s2")] * 4 + [(5001, None, "s3"), (5002, "", "only empty"), (5003, "x" * 10**6, "long")]


def result(frame, k=0):
    return Counter((r["doc_id"], r["size"], r["source_size"], r["targets"][k], r["copies"][k] if r["size"] else 0)
                   for r in frame.collect())


@pytest.mark.parametrize("share", [1.0, 0.1, 2.5])
def test_mix_matches_sorting(spark, share):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows()], "doc_id long, text string, source string, hash int, no int")
    assert result(mixing.mixed(docs.repartition(5), (share,))) == plain(rows(), share)


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    first = mixing.mixed(docs.repartition(3)).withColumn("taken", mixing.F.expr("size * copies[0]"))
    got = first.collect()
    assert max(r["copies"][0] for r in got) <= 3
    taken, largest, target = Counter(), Counter(), {}
    source = {(i, len((t or "").split())): s for i, t, s in rows()}
    for r in got:
        s = source[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        largest[s], target[s] = max(largest[s], r["size"] * (4 if r["doc_id"] == 5000 else 1)), r["targets"][0]
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 for s in target)
    assert result(mixing.mixed(docs.repartition(8))) == result(first)


def test_smaller_shares_lie_within_larger(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    out = mixing.mixed(docs, (0.2, 0.7, 1.0, 1.9))
    assert all(list(r["copies"]) == sorted(r["copies"]) for r in out.collect())
    for k, share in enumerate((0.2, 0.7, 1.0, 1.9)):
        assert result(out, k) == plain(rows(), share)


def test_mixture_repeats_whole_rows(spark):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows(200))], "doc_id long, text string, source string, plan long")
    times = Counter()
    for r in mixing.mixed(docs).collect():
        times[r["doc_id"], r["size"]] += r["copies"][0]
    got = mixing.mixture(docs)
    assert got.columns == docs.columns
    found = Counter((r["doc_id"], len((r["text"] or "").split())) for r in got.collect())
    assert {k: n for k, n in found.items() if k[1]} == {k: n for k, n in times.items() if n and k[1]}


def test_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mixed(spark.createDataFrame([], schema)).collect() == []
    empty = mixing.mixed(spark.createDataFrame([(1, None, None), (2, "", "a")], schema)).collect()
    assert sorted((r["doc_id"], r["size"], r["targets"][0]) for r in empty) == [(1, 0, 0.0), (2, 0, 0.0)]
    with pytest.raises(ValueError):
        mixing.mixed(spark.createDataFrame([(1, "a", "s")], schema), (3.5,))
