"""Texts searched as Arrow columns, and what the plans that use them do once."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from rolecall.functions.arrow_text import TermIndex, folded, scannable
from rolecall.operators import keywords
from rolecall.operators.filters import FilterSpec, apply_filters
from rolecall.operators.numbering import row_numbers
from rolecall.operators.scoring import derive, with_hits
from rolecall.operators.sorting import stored_order, typed_order
from rolecall.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_of_an_index_are_found_like_substrings():
    draw = random.Random(5)
    texts = [None if i % 17 == 3 else "".join(draw.choices("abc dé", k=draw.randrange(60))) for i in range(300)]
    terms = sorted({"".join(draw.choices("abc d", k=draw.choice([1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 17]))) for _ in range(200)}
                   | {texts[0][:20], "a" * 40})
    terms = [t for t in terms if t.isascii() and t]
    index = TermIndex([t.encode() for t in terms])
    whole = pa.array(texts, pa.string())
    for part in (whole, whole[7:250], whole[:0]):
        rows, which = index.held(folded(part))
        wanted = [(r, k) for r, t in enumerate(part.to_pylist()) for k, term in enumerate(terms) if t and term in t]
        assert list(zip(rows.tolist(), which.tolist())) == wanted


def test_folding_and_what_can_be_scanned():
    assert folded(pa.array(["ÉA/İıſK", None, "x/Y"]), slashes=False).to_pylist() == ["Éa iisk", None, "x y"]
    assert scannable("größe") is None and scannable(r"\d+") is None and scannable("a++") is None and scannable("A.b") is None
    assert scannable(r"c\+\+") == (r"c\+\+", None) and scannable(r"ph\.?d")[1] == r"ph\.?d"


def test_hits_of_scanned_and_other_patterns_keep_their_order(spark):
    rows = spark.createDataFrame([(1, "On ſales", "a1 größe"), (2, None, "resales x9y"), (3, "salesß, sales", None)], "i int, title string, description string")
    got = with_hits(rows, [r"\d", r"\bsales\b", "größe", "sales", "(?:x|a).", ""]).orderBy("i").collect()
    assert [r["_hits"] for r in got] == [[0, 1, 2, 3, 4, 5], [0, 3, 4, 5], [1, 3, 4, 5]]


def test_degree_tests_run_once_in_a_filtered_plan(spark):
    rows = spark.createDataFrame([(1, "BS/MS in CS", "Ohio"), (2, None, None)], "ord int, description string, location string")
    plan = plan_of(apply_filters(derive(rows), {"b": FilterSpec("degree_bin", (1, 3))}).select("ord", "degree_bin"))
    assert plan.count("ArrowEvalPython") == 1 and "RLIKE" not in plan


def test_scores_of_many_terms_move_no_words(spark):
    rows = spark.createDataFrame([(1, "alpha beta", "gamma"), (2, None, "Beta  x"), (3, "", None)], "ord long, title string, description string")
    terms = spark.createDataFrame([(i, f"term{i}", 1) for i in range(150)] + [(200, "alpha beta", 3), (201, "beta", 5), (202, "a(?=m)", 7)],
                                  "place long, term string, weight int")
    scored = keywords.keyword_scores(rows, terms, "ord")
    assert "Exchange" not in plan_of(scored)
    assert sorted((r[0], r[1], r[2]) for r in scored.collect()) == [(1, 15, ["alpha beta", "beta", "a(?=m)"]), (2, 5, ["beta"]), (3, 0, [])]


def test_rows_that_repeat_a_key_or_have_none(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "alpha", None), (1, "beta", "alpha"), (None, "alpha", None)], "ord long, title string, description string")
    terms = spark.createDataFrame([(i, f"term{i}", 1) for i in range(110)] + [(200, "alpha", 3), (201, "beta", 5)], "place long, term string, weight int")
    wanted = [(1, 8, ["alpha", "beta"])] * 2 + [(None, 0, [])]

    def got():
        return sorted(((r[0], r[1], r[2]) for r in keywords.keyword_scores(rows, terms, "ord").collect()), key=str)

    assert got() == wanted
    monkeypatch.setattr(keywords, "MOST_SCANNED", 5)  # the distributed way
    assert got() == wanted


def test_sort_keys_are_computed_once_a_row(spark):
    cells = ["10 km", "9", "Émile", "emile", None, "(x", ""]
    rows = spark.createDataFrame(list(enumerate(cells)), "ord int, cell string")
    kept, order = stored_order(rows, [("cell", False)])
    sort = next(line for line in plan_of(kept.orderBy(*order)).splitlines() if "Sort [" in line)
    assert "regexp_extract" not in sort
    ranked = row_numbers(kept, [*order, F.col("ord")]).orderBy("rank")
    plain = rows.orderBy(*typed_order([("cell", False)]), "ord")
    assert [r.ord for r in ranked.collect()] == [r.ord for r in plain.collect()]


def test_landed_files_are_compressed(spark):
    batch = QUERIES["collected_batch"](spark, "/root/testdata/sf0.001")
    assert all(f.endswith(".json.gz") for f in batch.inputFiles())
