"""Near copies, repeated passages and benchmark leaks against plain versions."""

import hashlib
import random
import string

import numpy as np
import pyarrow as pa
import pytest

from rolecall.llm import decontaminate, near, repeats
from rolecall.llm.components import components
from rolecall.llm.common import WordHashes


def words(rng, n, size=400):
    return [f"w{rng.randint(0, size)}" for _ in range(n)]


def shingles(text, width):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i:i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


def plain_groups(docs, width, percent):
    sets = [(i, shingles(t, width)) for i, t in docs]
    label = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= percent * len(a | b) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return [(i, len(s), label[i]) for i, s in sets]


@pytest.mark.parametrize("width", [2, 5])
def test_groups_match_brute_force(spark, width):
    rng = random.Random(width)
    docs = []
    for base in range(12):
        text = words(rng, rng.choice([3, 8, 40, 150]))
        for _ in range(rng.randint(1, 6)):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 30))):
                copy[rng.randrange(len(copy))] = "edit"
            docs.append(" ".join(copy))
            text = copy if rng.random() < 0.5 else text  # chains: ends are less alike than neighbours
    docs += [None, "", "  \n", "one", "ONE", "one two", "Ä", "ä", "a b c d", "A B\tc  d"]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    frame = spark.createDataFrame([(*d, "x", [1]) for d in docs], "doc_id long, text string, digest string, bands array<int>")
    got = sorted(tuple(r) for r in near.groups(frame, width, 80).collect())
    assert got == plain_groups(docs, width, 80)
    kept = near.deduplicated(frame, width, 80)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, c in got if i == c]


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (None, None), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(near.groups(frame).collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (None, 0, None), (None, 2, None)]
    kept = sorted((tuple(r) for r in near.deduplicated(frame).collect()), key=str)
    assert kept == sorted([rows[0], rows[3], rows[4], rows[5]], key=str)
    assert near.groups(frame.where("false")).count() == near.deduplicated(frame.where("false")).count() == 0


def test_rows_of_one_id_with_other_texts(spark):
    rows = [(1, "a b c d e f", 1), (1, "u v w x y z", 2), (1, "a b c d e f", 1), (2, "U v w x y z", 3), (3, "", 4), (3, None, 5), (4, "q r", 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    got = sorted(tuple(r) for r in near.groups(frame).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 0, 3), (4, 1, 4)]
    kept = sorted((tuple(r) for r in near.deduplicated(frame).collect()), key=str)
    assert kept == sorted([rows[0], rows[1], rows[4], rows[5], rows[6]], key=str)


@pytest.mark.parametrize("percent, least", [(80, 7), (60, 3), (50, 2), (95, 7), (10, 1), (100, 7)])
def test_bands_follow_from_the_similarity(percent, least):
    bands, rows = near.bands_for(percent)
    assert rows == least and (1 - min(percent / 100, 0.99) ** rows) ** bands <= near.MISSED
    with pytest.raises(ValueError):
        near.bands_for(0)


def test_lower_similarity_matches_brute_force(spark):
    rng = random.Random(6)
    docs = []
    for base in range(25):
        text = words(rng, 40)
        for _ in range(3):
            docs.append(" ".join("edit" if rng.random() < 0.12 else w for w in text))
    docs = list(enumerate(docs))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in near.groups(frame, 1, 50).collect()) == plain_groups(docs, 1, 50)


def test_links_in_a_cloud(spark):
    """Hundreds of texts that are all almost similar enough, so that every bucket stays open."""
    rng = random.Random(11)
    base, docs = words(rng, 150, 5000), []
    for i in range(500):
        text = list(base)
        for k in rng.sample(range(150), rng.choice([4, 5, 5, 5, 6])):  # similarities of .72 to .81 in pairs
            text[k] = f"new{rng.randint(0, 3)}_{k}"
        docs.append((i, " ".join(text)))
    sets = [near.word_set(WordHashes(), t.encode(), 2) for _, t in docs]
    links = [(i, j) for i in range(500) for j in range(i) if 100 * (k := len(np.intersect1d(sets[i], sets[j], True))) >= 80 * (
        len(sets[i]) + len(sets[j]) - k)]
    got = {r["doc_id"]: r["component_id"] for r in near.groups(spark.createDataFrame(docs, "doc_id long, text string"), 2, 80).collect()}
    found = sum(got[i] == got[j] for i, j in links)
    assert 1000 < len(links) < 0.2 * 500 * 499 / 2 and found >= 0.99 * len(links)


def test_no_link_of_an_open_bucket_is_left_out(spark, monkeypatch):
    """What drawn classes miss is found by comparing all that is left, tile by tile."""
    rng = random.Random(13)
    base, docs = words(rng, 150, 5000), []
    for i in range(120):
        text = list(base)
        for k in rng.sample(range(150), rng.choice([5, 6, 7])):
            text[k] = f"new{rng.randint(0, 3)}_{k}"
        docs.append((i, " ".join(text)))
    monkeypatch.setattr(near, "SPLITS", [(0, 0)])
    monkeypatch.setattr(near, "TILE", 16)
    got = sorted(tuple(r) for r in near.groups(spark.createDataFrame(docs, "doc_id long, text string"), 2, 80).collect())
    assert got == plain_groups(docs, 2, 80)


def rows_made(frame):
    """Rows out of the node of a collected frame's plan that made most."""
    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from walk(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from walk(node.plan())
        made = node.metrics().get("numOutputRows")
        if made.isDefined():
            yield made.get().value()
        for k in range(node.children().size()):
            yield from walk(node.children().apply(k))

    return max(walk(frame._jdf.queryExecution().executedPlan()))


def test_unlike_classes_of_a_bucket_make_no_rows(spark, monkeypatch):
    """Pairs of a bucket are compared in arrays: what is made in rows follows the bucket, not its square."""
    rng = np.random.default_rng(17)
    size, kinds = 600, [rng.permutation(near.BINS) < 100 for _ in range(600)]
    named = spark.createDataFrame([(5, i, 100, i) for i in range(size)], "key long, id long, n long, c long")
    kinds[411] = kinds[7]
    bins = spark.createDataFrame([(i, bytearray(k.astype(np.uint8).tobytes())) for i, k in enumerate(kinds)], "id long, bins binary")
    for tile in (near.TILE, 64, 1000):
        monkeypatch.setattr(near, "TILE", tile)
        found = near._crossing(named, bins, 80)
        assert [tuple(r) for r in found.collect()] == [(7, 411)]
        assert rows_made(found) <= size * -(-size // tile)


def test_tiles_that_span_batches():
    rows = [(k, 0, 0, v) for k in (3, 1, 2) for v in range(5)] + [(2, 0, 1, 9), (2, 1, 1, 9)]
    table = pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["key", "i", "j", "v"])
    for size in (1, 2, 5, 7, 100):
        got = [[tuple(r.values()) for r in t.to_pylist()] for t in near._tiles(iter(table.to_batches(max_chunksize=size)))]
        assert got == [rows[:5], rows[5:10], rows[10:15], rows[15:16], rows[16:]]


def test_very_long_texts_are_compared_whole(spark):
    rng = random.Random(12)
    text = words(rng, 60_000, 50_000)
    other = text[:50_000] + words(rng, 12_000, 50_000)
    docs = [(1, " ".join(text)), (2, " ".join(text[:59_000])), (3, " ".join(other)), (4, "short")]
    got = [r["component_id"] for r in near.groups(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [r[2] for r in plain_groups(docs, 5, 80)] == [1, 1, 3, 4]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for size in (1, 4, 60, 2000):
        pool = rng.integers(0, 1 << 63, 2 * size, np.uint64)
        one, other = pool[:size], np.concatenate([pool[:size - size // 5], pool[size:size + size // 5]])
        a, b, again = near.sketches([one, other, one[::-1]], 413)
        assert (a != near.EMPTY).all() and (a == again).all()
        true = len(set(one.tolist()) & set(other.tolist())) / len(set(one.tolist()) | set(other.tolist()))
        assert abs((a == b).mean() - true) < 0.25


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20, 45)] + [(100, i) for i in range(101, 140)] + [(7, 139), (3, 4)]
    got = {r["v"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {20, 7, 3}
    assert all(got[i] == 20 for i in range(20, 46)) and all(got[i] == 7 for i in range(100, 140))


def plain_repeats(docs):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, ws in split:
        for k in range(len(ws) - 49):
            key = tuple(ws[k:k + 50])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, ws in split:
        gone = set()
        for k in range(len(ws) - 49):
            if first[tuple(ws[k:k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = [w for k, w in enumerate(ws) if k not in gone]
        out.append((i, len(ws), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.fixture
def passages():
    rng = random.Random(4)
    shared = [words(rng, n) for n in (50, 51, 70, 130)] + [["same"] * 80, ["x", "y"] * 40, words(rng, 49)]
    docs = []
    for i in range(60):
        text = words(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            part = list(rng.choice(shared))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "edit"
            text += part + words(rng, rng.randint(0, 30))
        docs.append((i, (" " if i % 2 else "\n").join(text)))
    docs += [(60, docs[3][1]), (61, docs[3][1]), (62, None), (63, ""), (64, "é " * 49 + "é"), (65, "é " * 60)]
    return docs


@pytest.mark.parametrize("most", [repeats.MOST, 2])
def test_repeats_match_brute_force(spark, passages, most):
    frame = spark.createDataFrame([(*d, "p", 1) for d in passages], "doc_id long, text string, prefix string, start int")
    got = sorted(tuple(r) for r in repeats.summaries(frame.repartition(3), most).collect())
    assert got == plain_repeats(passages)


def test_small_batches_of_trees(spark, passages, monkeypatch):
    monkeypatch.setattr(repeats, "TOGETHER", 5)
    frame = spark.createDataFrame(passages, "doc_id long, text string")
    assert sorted(tuple(r) for r in repeats.summaries(frame).collect()) == plain_repeats(passages)


def test_texts_without_repeats(spark, passages):
    frame = spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in passages],
                                  "doc_id long, text string, source string, n_chars long")
    rows = {r["doc_id"]: r for r in repeats.without_repeats(frame).collect()}
    for (i, n, gone, sha), (_, text) in zip(plain_repeats(passages), sorted(passages)):
        if n and gone == n:
            assert i not in rows
        elif gone:
            assert hashlib.sha256(rows[i]["text"].encode()).hexdigest() == sha
            assert rows[i]["n_chars"] == len(rows[i]["text"])
        else:
            assert rows[i]["text"] == text and rows[i]["n_chars"] == len(text or "")
    again = spark.createDataFrame([(1, "a " * 60), (1, "a " * 60), (None, "a " * 60), (2, "a " * 60)], "doc_id long, text string")
    got = sorted((tuple(r)[:3] for r in repeats.summaries(again).collect()), key=str)
    assert got == [(1, 60, 0), (1, 60, 0), (2, 60, 60), (None, 60, 0)]
    assert repeats.summaries(again.where("false")).count() == repeats.without_repeats(again.where("false")).count() == 0


def normal(text):
    return [w for w in ((text or "").encode().lower().split()) if w.strip(string.punctuation.encode())]


def plain_edits(item, text):
    a = [w.strip(string.punctuation.encode()) for w in normal(item)]
    b = [w.strip(string.punctuation.encode()) for w in normal(text)]
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row), len(a)


@pytest.fixture
def leaky():
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.randint(14, 50), 5000))) for i in range(30)]
    items += [(30, "too short"), (31, None), (32, ""), (33, items[0][1])]
    docs = []
    for i in range(150):
        text = words(rng, rng.randint(0, 120), 5000)
        if i % 2:
            part = rng.choice(items[:30])[1].split()
            for _ in range(rng.randint(0, len(part) // 6)):
                k = rng.randrange(len(part))
                part[k:k + 1] = rng.choice([[], ["edit"], [part[k], "more"]])
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() + "," if rng.random() < 0.2 else w for w in part]
        docs.append((i, " ".join(text)))
    return items, docs + [(150, None), (151, ""), (152, items[2][1]), (152, items[2][1]), (153, " -- ".join(items[3][1].split()))]


def test_leaks_match_brute_force(spark, leaky):
    items, docs = leaky
    frame = spark.createDataFrame([(*d, [0]) for d in docs], "doc_id long, text string, item_ids array<long>")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = {r["doc_id"]: dict(zip(r["item_ids"], r["item_edits"])) for r in decontaminate.find(frame, bench).collect()}
    assert len(got) == len(dict(docs))
    wanted = missed = 0
    for i, text in docs:
        for item_id, item in items:
            fewest, n = plain_edits(item, text)
            if n and fewest <= int(0.2 * n + 1e-9):
                wanted += 1
                assert got[i].get(item_id) == fewest
            else:
                assert item_id not in got[i]
    assert wanted > 60
    kept = decontaminate.clean(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, found in got.items() if not found)


def test_benchmarks_in_passes(spark, leaky, monkeypatch):
    items, docs = leaky
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    once = sorted(tuple(map(str, r)) for r in decontaminate.find(frame, bench).collect())
    monkeypatch.setattr(decontaminate, "MOST_ITEMS", 12)
    many = decontaminate.find(frame, bench).collect()
    assert sorted(tuple(map(str, r)) for r in many) == once
    assert decontaminate.find(frame.where("false"), bench).count() == 0
    assert not any(r["item_ids"] for r in decontaminate.find(frame, bench.where("false")).collect())


def edited(rng, part, most):
    for k in sorted(rng.sample(range(len(part)), most), reverse=True):
        part[k:k + 1] = rng.choice([[], ["edit"], [part[k], "more"]])
    return part


def recall_at(n, count=300):
    """The share of n-word items that walks find with a fifth of their words edited, and their edits right."""
    rng = random.Random(n)
    items = [(i, " ".join(words(rng, n, 5000))) for i in range(count)]
    block, hashes = decontaminate.Items(items), decontaminate._Words()
    texts = [" ".join([*words(rng, 30, 5000), *edited(rng, t.split(), n // 5), *words(rng, 30, 5000)]) for _, t in items]
    found = block.leaks([hashes.text(t.encode()) for t in texts])
    for (i, item), text, leaks in zip(items, texts, found):
        if i in leaks:
            assert leaks[i] == plain_edits(item, text)[0] <= n // 5
    return sum(i in leaks for (i, _), leaks in zip(items, found)) / count


@pytest.mark.parametrize("n", [8, 10, 11, 14, 15, 16, 18, 20, 24, 25, 30, 40, 50, 80])
def test_recall_at_the_full_fifth_of_edits(n):
    assert recall_at(n) >= (0.99 if n >= decontaminate.SHORT else 1)


def test_walks_follow_from_the_target():
    few, many = (decontaminate.walks_for({10: 2, 15: 3}, 10, recall) for recall in (0.8, 0.999))
    assert 1 <= few < many <= decontaminate.MOST_WALKS
    with pytest.raises(ValueError):
        decontaminate.walks_for({10: 9}, 10, trials=50)


def test_walks_fall_in_step_after_an_edit():
    rng = np.random.default_rng(4)
    one = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    other = np.concatenate([one[:100], rng.integers(1, 1 << 62, 2).astype(np.uint64), one[101:]])  # one replaced, one added
    walks, near, far = decontaminate.Walks(16), 0, 0
    for walk in range(decontaminate.MOST_WALKS):
        a, b = (next(walks.keys(decontaminate.laid_out([x])[0], walk))[0] for x in (one, other))
        assert (a[:88] == b[:88]).all()  # windows before the edit
        near += (a[102:280] == b[103:281]).mean()
        far += (a[102:280] == b[105:283]).mean()
    assert near == decontaminate.MOST_WALKS and far < 1


def test_words_in_another_order_are_no_leak():
    rng = random.Random(3)
    item = words(rng, 30, 5000)
    block, hashes = decontaminate.Items([(1, " ".join(item))]), decontaminate._Words()
    assert block.leaks([hashes.text(" ".join(reversed(item)).encode()), hashes.text(b""), hashes.text(b"-- ,")]) == [{}, {}, {}]


def test_very_long_text_is_read_to_its_end():
    rng = random.Random(5)
    item = words(rng, 20, 5000)
    text = ["common"] * 300_000 + edited(rng, list(item), 4)
    block, hashes = decontaminate.Items([(1, " ".join(item)), (2, "common " * 12)]), decontaminate._Words()
    assert block.leaks([hashes.text(" ".join(text).encode())]) == [{1: plain_edits(" ".join(item), " ".join(text[-30:]))[0], 2: 0}]


@pytest.mark.parametrize("before", range(9))
@pytest.mark.parametrize("after", range(5))
def test_shortest_item_is_found_at_every_offset_from_the_end(before, after):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, 16, 5000))) for i in range(40)]
    block, hashes = decontaminate.Items(items), decontaminate._Words()
    texts = [" ".join([*["before"] * before, item, *["after"] * after]) for _, item in items]
    assert block.leaks([hashes.text(t.encode()) for t in texts]) == [{i: 0} for i, _ in items]


@pytest.mark.parametrize("n", range(1, 8))
def test_short_items_are_found(n):
    rng = random.Random(n)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(n))) for i in range(20)]
    block, hashes = decontaminate.Items(items), decontaminate._Words()
    for most in {0, n // 5}:
        texts = [" ".join([*words(rng, 9, 5000), *edited(rng, t.split(), most), *words(rng, 9, 5000)]) for _, t in items]
        found = block.leaks([hashes.text(t.encode()) for t in texts])
        assert found == [{i: plain_edits(t, text)[0]} for (i, t), text in zip(items, texts)]


def test_word_hashes_stay_bounded(monkeypatch):
    monkeypatch.setattr(WordHashes, "LIMIT", 10)
    hashes = WordHashes()
    ws = [str(i).encode() for i in range(100)]
    assert (hashes.of(ws) == hashes.of(ws)).all() and len(hashes) <= 10
