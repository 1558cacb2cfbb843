"""Alignment of two tokenizers against whole-text encoding and pairwise comparison of byte ranges."""

import hashlib
from collections import Counter, defaultdict

import pytest

from rolecall.llm import align

TEXTS = [
    None, "", " ", "a", "The cat sat on the mat.", "The cat  sat\n on the\n\n mat. ", "  two leading", "trailing  ",
    "it's Jürgen's naïve café x", "tab\there 'S 's don't", "日本語 テキスト 😀👍🏽", "▁marker in text", "<0x41> <s> </s> <unk>",
    "<|endoftext|> plain", "x" * 3000, "a\x00b", "é ﬁ ½", "number 1234567 and\r\nline", "The cat sat on the mat.", "\n \n x",
    " wide space", "end  x", "word " * 700, "ß" * 50 + " " * 40 + "z",
]


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha256) of every text, by brute force."""
    tables = align.Tokenizers().loaded()
    rows, links, held = [], [], defaultdict(set)
    for i, text in enumerate(texts):
        whole = (" " + text).encode() if text else b""
        a = tables.first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tables.second.encode(text) if text else []
        sides = []
        for ids, spelled in ((a, tables.a_bytes), (b, tables.b_bytes)):
            at, spans = 0, []
            for x in ids:
                spans.append((at, at + len(spelled[x]), x))
                at += len(spelled[x])
            sides.append(spans if b"".join(spelled[x] for x in ids) == whole else None)
        a, b = sides if None not in sides else ([], [])
        mine = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]] if len(a) < 2000 else None
        if mine is None:
            mine = []
            for x in a:
                mine += [(x[2], y[2]) for y in b if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in a} & {y[1] for y in b})
        groups, low = [], 0
        for end in ends:
            groups.append(",".join(str(x[2]) for x in a if low < x[1] <= end) + "|"
                          + ",".join(str(y[2]) for y in b if low < y[1] <= end))
            low = end
        rows.append([len(a), len(b), len(groups), len(mine), ";".join(groups)])
        links.append(Counter(mine))
        for pair in links[-1]:
            held[pair].add(i)
    counts = {p: len(d) for p, d in held.items()}
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [(*r[:4], sum(n for p, n in l.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in l.items()),
             hashlib.sha256(r[4].encode()).hexdigest() if r[4] else "") for r, l in zip(rows, links)]


def result(frame):
    return sorted(tuple(r[c] for c in ("doc_id", *align.COUNTS, "n_best", "count_sum", "groups_sha256"))
                  for r in frame.collect())


def test_alignment_matches_brute_force(spark):
    texts = TEXTS[:-2] + ["word " * 30, TEXTS[-1]]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, block int, keys string")
    assert result(align.align(docs.repartition(3))) == [(i, *r) for i, r in enumerate(plain(texts))]


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = result(align.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert got == [(i, *r) for (i, _), r in zip(rows, plain([t for _, t in rows]))]


def test_repeated_rows_and_missing_ids_are_documents(spark):
    texts = ["one two", "one two", "one two three", None]
    docs = spark.createDataFrame([(7, texts[0]), (7, texts[1]), (None, texts[2]), (None, None)], "doc_id int, text string")
    got = Counter(tuple(r) for r in align.align(docs).collect())
    wanted = Counter((i, *x[:6], x[6]) for i, x in zip((7, 7, None, None), plain(texts)))
    assert Counter((r[0], *r[1:5], *r[5:]) for r in got.elements()) == wanted


def test_empty_table(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("memo", [1, 50, 200_000])
def test_words_are_cut_where_no_token_crosses(memo, monkeypatch):
    monkeypatch.setattr(align, "MEMO", memo)
    tables = align.Tokenizers().loaded()
    texts = [t for t in TEXTS if t]
    for text, (a, b) in zip(texts, tables.encode(texts)):
        whole = (" " + text).encode()
        wanted = tables.first.encode(" " + text, add_special_tokens=False).ids, tables.second.encode(text)
        if (b"".join(tables.a_bytes[i] for i in wanted[0]) == whole
                and b"".join(tables.b_bytes[i] for i in wanted[1]) == whole):
            assert (a.tolist(), b.tolist()) == wanted, text
        else:
            assert not len(a) and not len(b), text


def test_special_strings_are_plain_text():
    (a, _), = align.Tokenizers().loaded().encode(["<|endoftext|>"])
    assert len(a) > 1 and 50256 not in a


def test_very_long_text(spark):
    text = "lengthy words and 12 numbers. " * 200_000  # over a block
    row = align.align(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")).where("doc_id = 1").first()
    one = plain([text[:3000]])[0]
    assert row["n_a"] > 1_000_000 and row["n_links"] >= row["n_a"]
    assert abs(row["n_a"] / len(text) - one[0] / 3000) < 0.01
