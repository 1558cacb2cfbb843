"""URL rules, exact top-k, tool calls and pieces against plain versions."""

import json
import random

import numpy as np
import pytest

from rolecall.llm import chat, spm, topk, urls
from rolecall.llm.queries import RULES

URLS = {
    "http://tionsh.Example.NET/en/1": ("tionsh.example.net", "/en/1", "example.net/en/", "allow"),
    "https://example.net/fr/": ("example.net", "/fr/", "net/", "block"),
    "https://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
    "https://net": ("net", "", None, "allow"),
    "https://net/": ("net", "/", "net/", "block"),
    "ftp://m.example.com/de/a?x=/../#y": ("m.example.com", "/de/a", "example.com/de/", "block"),
    "https://example.com/dE/": ("example.com", "/dE/", None, "allow"),
    "https://a.org/fr/x": ("a.org", "/fr/x", "org/fr/", "allow"),
    "https://a.org?/fr/": ("a.org", "", None, "allow"),
    "https://ÄB.net/#": ("Äb.net", "/", "net/", "block"),
    "//example.net/": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "x://y://net/": ("y:", "//net/", None, "allow"),
    "https://.net/": (".net", "/", "net/", "block"),
}


def test_url_verdicts(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)]
    pages = spark.createDataFrame([*rows, (None, "https://net/", "", "")],
                                  "page_id long, url string, host string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(pages, RULES).collect()}
    assert [got[i] for i in range(len(URLS))] == list(URLS.values())
    assert got[None][-1] == "block"
    assert urls.judge(pages.where("false"), RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, []).collect()} == {"allow"}


def test_colliding_keys_do_not_matter(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda data: len(data) % 2)
    (tmp_path / "index").write_bytes(urls.digest(RULES))
    index = urls.DigestArray(str(tmp_path / "index"))
    got = index.longest([urls.split(u) for u in URLS])
    assert [(g or (None, "allow")) for g in got] == [v[2:] for v in URLS.values()]


def plain_top(rows, queries, k):
    held = {}
    for key, vector in rows:
        if key is not None and vector and None not in vector and all(map(np.isfinite, vector)):
            held.setdefault(key, []).append([int(np.floor(1024 * float(np.float32(x)))) for x in vector])
    out = []
    for q in sorted(held):
        if q % queries == 0:
            scored = [(-max(min(sum(a * b for a, b in zip(held[q][0], v)), topk.LONG), -topk.LONG), c) for c, vs in held.items() for v in vs
                      if c != q and len(v) == len(held[q][0])]
            out += [(q, i, c, -s) for i, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [0.5, 1e6, 3e7])
def test_top_k_matches_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1, 0, 0.25, 1]) * size for _ in range(3)]) for i in range(150)]  # many ties
    rows += [(200 + i, [float(i), 1.0]) for i in range(4)]  # fewer than k of this length
    rows += [(300, None), (310, []), (320, [None, 1.0, 2.0]), (330, [float("nan"), 0.0, 1.0]),
             (340, [float("inf"), 0.0, 1.0]), (None, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in topk.top_k(frame.where("vec_id % 10 = 0"), frame.repartition(5), 6).collect())
    assert got == plain_top(rows, 10, 6)


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(none, some).count() == topk.top_k(some, none).count() == topk.top_k(some, some).count() == 0


SCHEMAS = {"sum": {"properties": {"a": {"type": "number"}, "how": {"type": "string", "enum": ["x", "y"]},
                                  "list": {"type": "array"}, "n": {"type": "integer", "maximum": 9}},
                   "required": ["a"], "additionalProperties": False},
           "free": {}}
CALLS = [
    ("1", 1, "sum", '{"how": "x", "a": 1.50}', 0, "", '{"a":1.5,"how":"x"}'),
    ("2", 3, "sum", '{"a": {"$ref": "1"}}', 1, "type a", '{"a":{"$ref":"1"}}'),
    ("3", 4, "free", '{"z": {"$ref": "2"}, "b": {"$ref": "1"}, "é\\n": [1, {"y": null, "x": true}]}', 2, "",
     '{"b":{"$ref":"1"},"z":{"$ref":"2"},"é\\n":[1,{"x":true,"y":null}]}'),
    ("4", 5, "sum", '{"how": "z", "n": 10, "q": 1}', 0, "enum how,large n,missing a,unexpected key", '{"how":"z","n":10,"q":1}'),
    ("5", 6, "sum", "{bad", 0, "not json", "null"),
    ("6", 7, "sum", None, 0, "not json", "null"),
    ("7", 8, "nope", '{"a": {"$ref": "gone"}}', 0, "unknown tool", '{"a":{"$ref":"gone"}}'),
    ("8", 9, "free", '{"a": {"$ref": "9"}}', None, "cycle", '{"a":{"$ref":"9"}}'),
    ("9", 10, "free", '{"a": {"$ref": "8"}}', None, "cycle", '{"a":{"$ref":"8"}}'),
    ("10", 11, None, "[1]", 0, "unknown tool", "[1]"),
    ("11", 12, "sum", '{"a": null, "list": 3}', 0, "type a,type list", '{"a":null,"list":3}'),
]


def test_tool_calls(spark):
    calls = spark.createDataFrame([(1, *c[:4], "extra") for c in CALLS],
                                  "conv_id long, call_id string, turn long, name string, arguments string, content string")
    results = spark.createDataFrame(
        [(1, "1", 2, 'a "b"\n'), (1, "2", 4, None), (1, "none", 5, "x"), (2, "1", 2, "other"), (1, "3", 8, ""), (1, "3", 9, "é")],
        "conv_id long, call_id string, turn long, content string")
    rows = chat.linked(calls, results, SCHEMAS).collect()
    orphans = [r for r in rows if list(r["problems"]) == ["no call"]]
    assert sorted((r["conv_id"], r["call_id"], r["turn"], r["depth"], r["linked"], r["result_turn"], r["message"]) for r in orphans) == [
        (1, "none", None, None, False, 5, '{"arguments":null,"content":"x","id":"none","name":null}'),
        (2, "1", None, None, False, 2, '{"arguments":null,"content":"other","id":"1","name":null}')]
    rows = [r for r in rows if r not in orphans]
    got = {r["call_id"]: r for r in rows}
    assert len(rows) == len(CALLS) + 1
    for call_id, _, name, _, depth, problems, arguments in CALLS:
        row = got[call_id]
        assert (row["depth"], ",".join(row["problems"])) == (depth, problems), call_id
        assert row["message"].startswith('{"arguments":' + arguments + ',"content":'), row["message"]
        assert row["linked"] == (call_id in ("1", "2", "3"))
        assert json.loads(row["message"])["name"] == name
    assert got["1"]["message"] == '{"arguments":{"a":1.5,"how":"x"},"content":"a \\"b\\"\\n","id":"1","name":"sum"}'
    assert sorted(r["result_turn"] for r in rows if r["call_id"] == "3") == [8, 9]
    assert chat.linked(calls.where("false"), results.where("false"), SCHEMAS).count() == 0


NUMBERS = {
    "1e2": "100", "100": "100", "100.0": "100", "1.00E+2": "100", "-0": "0", "0.0": "0", "-0.0e5": "0", "1e-7": "1e-7", "0.0000001": "1e-7",
    "0.000001": "0.000001", "1e400": "1e+400", "-1.50": "-1.5", "123456789012345678901": "123456789012345678901",
    "1234567890123456789012": "1.234567890123456789012e+21", "1e21": "1e+21", "1e20": "100000000000000000000",
    "0.1000000000000000055511151231257827": "0.1000000000000000055511151231257827", "12.5e-1": "1.25", "-12e-9": "-1.2e-8", "7": "7",
}


def canonical(name):
    return chat.canonical(chat.F.col(name))


def test_numbers_have_one_spelling(texts):
    rows = [f'{{"b": [{n}, "{n}"], "a": {n}}}' for n in NUMBERS] + [f" {n} " for n in NUMBERS]
    wanted = [f'{{"a":{c},"b":[{c},"{n}"]}}' for n, c in NUMBERS.items()] + list(NUMBERS.values())
    assert texts(rows, canonical) == wanted


def test_canonical_texts(texts):
    odd = ['"a\\\\\\"1\\\\"', '{"\\u0001n5": "\\u0001n5", "\\u0001s": "1"}', '["\\u00e9\\/", "\\n", true, null, false, -1]', "{}", "[]", '""', "nul", None,
           '{"a": 1, "a": 2}', '{"a" :\n [ 1 , {"c":2, "b" : "x, 1.0: \\"2.0\\""} ] }', '"' + "\\n1" * 20_000 + '"']
    got = texts(odd, canonical)
    assert got[:9] == ['"a\\\\\\"1\\\\"', '{"\\u0001n5":"\\u0001n5","\\u0001s":"1"}', '["é/","\\n",true,null,false,-1]', "{}", "[]", '""', None, None, None]
    assert got[9] == '{"a":[1,{"b":"x, 1.0: \\"2.0\\"","c":2}]}' and got[10] == odd[10]


def test_references_at_any_level(texts):
    rows = ['{"a": [{"$ref": "x"}, {"b": {"$ref": "y\\"é"}}], "c": "\\"$ref\\":\\"no\\"", "$ref": 5}', '{"\\u0024ref": "z"}', "[]", None, '"$ref"',
            '["$ref", "no"]']
    assert texts(rows, lambda t: chat.references(canonical(t))) == [["x", 'y"é'], ["z"], [], None, [], []]


NESTED = {"book": {
    "type": "object", "required": ["trip"], "properties": {
        "trip": {"type": "object", "required": ["to"], "additionalProperties": False, "properties": {
            "to": {"type": "string", "pattern": "^[A-Z]{3}$"}, "legs": {"type": "array", "minItems": 1, "maxItems": 2, "items": {
                "type": "object", "properties": {"km": {"type": "integer", "minimum": 0}}, "required": ["km"]}}}},
        "note": {"type": ["string", "null"], "maxLength": 3}}}}


def test_nested_schemas(texts):
    rows = {
        '{"trip": {"to": "OSL", "legs": [{"km": 5}, {"km": 1e2}]}, "note": null}': "",
        '{"trip": {"to": "osl", "legs": []}}': "few trip.legs,pattern trip.to",
        '{"trip": {"legs": [{"km": -1}, {"km": 1.5}, {}], "x": 1}, "note": "long"}':
            "long note,many trip.legs,missing trip.legs[].km,missing trip.to,small trip.legs[].km,type trip.legs[].km,unexpected key in trip",
        '{"trip": 5, "note": 1}': "type note,type trip", "[]": "type", '{"trip": {"to": "OSL", "legs": [3]}}': "type trip.legs[]",
        '{"trip": {"to": "OSL", "legs": [{"km": 1e400}]}}': "",
    }
    got = texts(list(rows), lambda t: chat.F.array_join(chat.problems(chat.F.lit("book"), t, NESTED), ","))
    assert got == list(rows.values())
    with pytest.raises(ValueError, match="oneOf"):
        texts(["{}"], lambda t: chat.problems(chat.F.lit("book"), t, {"book": {"properties": {"a": {"oneOf": []}}}}))


def test_repeated_calls_missing_ids_and_long_arguments(spark):
    long = json.dumps({"text": "word 1.0 " * 50_000})
    calls = spark.createDataFrame(
        [(1, "a", 1, "free", "{}"), (1, "a", 2, "free", '{"b": 2.0}'), (None, "a", 3, "free", "{}"), (1, None, 4, "free", "{}"),
         (1, "b", 5, "free", long)], "conv_id long, call_id string, turn long, name string, arguments string")
    results = spark.createDataFrame([(1, "a", 6, "x"), (1, "a", 6, "x"), (None, "a", 7, "y"), (1, None, 8, "z")],
                                    "conv_id long, call_id string, turn long, content string")
    rows = chat.linked(calls, results, SCHEMAS).collect()
    got = sorted((str(r["conv_id"]), str(r["call_id"]), r["turn"] or 0, r["linked"], r["result_turn"] or 0, ",".join(r["problems"])) for r in rows)
    assert got == sorted([("1", "a", 1, True, 6, "")] * 2 + [("1", "a", 2, True, 6, "")] * 2 + [
        ("None", "a", 3, False, 0, ""), ("1", "None", 4, False, 0, ""), ("1", "b", 5, False, 0, ""),
        ("None", "a", 0, False, 7, "no call"), ("1", "None", 0, False, 8, "no call")])
    assert {r["message"] for r in rows if r["call_id"] == "b"} == {
        '{"arguments":{"text":"' + "word 1.0 " * 50_000 + '"},"content":null,"id":"b","name":"free"}'}


def test_chain_of_calls_with_several_references(spark):
    calls = [(1, str(i), i, "free", json.dumps({"x": [{"$ref": str(i - 1)}, {"$ref": str(i - 2)}]})) for i in range(12)]
    frame = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string")
    assert {r["call_id"]: r["depth"] for r in chat.depths(frame).collect()} == {str(i): i for i in range(12)}


@pytest.fixture(scope="module")
def vocabulary():
    return spm.Vocabulary.load()


ODD = ["", " ", "  a  b ", "日本語テキスト🙂 x", "a▁b", "\n\n", "x" * 100 + " é" * 3, "\x00\x7f", "ﬁ" * 60, "word " * 2000]


def test_texts_come_back(vocabulary):
    texts = [t.encode() for t in ODD]
    for _ in range(2):  # also from the memo
        assert vocabulary.decode(vocabulary.encode(texts)) == texts
    assert vocabulary.encode([]) == [] and vocabulary.decode([]) == []


def test_one_by_one_and_together_agree(vocabulary):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé 日$\n") for _ in range(rng.randint(1, 30))).encode() for _ in range(300)]
    for text, ids in zip(texts, vocabulary.segment_many(texts)):
        best = vocabulary.segment(text)
        assert sum(vocabulary.scores[ids]) == pytest.approx(sum(vocabulary.scores[best]))


def test_same_pieces_as_the_library(vocabulary):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    model = pb.ModelProto()
    with open(spm.MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for i, piece in enumerate(model.pieces):
        if piece.type in (1, 4):
            piece.score = float(vocabulary.scores[i])
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    rng = random.Random(2)
    words = ["the", "thstition", "éanment", "$$$", "日本", "a", "Überraschung", "x9", "🙂"]
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 20)))
        ids, wanted = vocabulary.encode([text.encode()])[0].tolist(), library.encode(text)
        if ids != wanted:  # a tie
            assert sum(vocabulary.scores[ids]) == pytest.approx(sum(vocabulary.scores[wanted]))


def test_pieces_of_rows(spark):
    docs = spark.createDataFrame([*((i, t, "k") for i, t in enumerate(ODD)), (None, None, None), (1, " ", "k")],
                                 "doc_id long, text string, decoded string")
    rows = spm.round_trip(docs).collect()
    assert len(rows) == len(ODD) + 2 and spm.round_trip(docs).columns == ["doc_id", "text", "piece_ids", "decoded"]
    for r in rows:
        assert r["decoded"] == r["text"] and (r["piece_ids"] is None) == (r["text"] is None)
    assert spm.encode(docs.where("false")).count() == 0
