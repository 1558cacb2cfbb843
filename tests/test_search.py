"""Search strings, many search terms, and the filter of keys."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rolecall.operators import key_filter
from rolecall.operators.dedup import affected_leaves, strict_anti
from rolecall.operators.keywords import keyword_hits, keyword_scores, term_table
from rolecall.operators.scoring import with_keywords
from rolecall.operators.search import SearchError, conjunction, disjunction, matching, negation, with_searches
from rolecall.plans.merge import batch_leaves, raw_archive_leaves

ROWS = [
    (1, "Software Engineer", "Python and Java, no interns"), (2, "Engineer", "software, PYTHON"), (3, "Intern", "python software engineer"),
    (4, None, "java"), (5, "Java", None), (6, None, None), (7, "R&D and more", 'says "AND" (twice)'), (8, "Größe", "Software Engineer: JAVA"),
]
SEARCHES = {
    '"software engineer" AND (python OR java) NOT intern': [8],
    '"software engineer" AND (python OR java)': [1, 3, 8],
    "python java": [1],
    "python OR java AND engineer": [1, 2, 3, 8],
    "(python OR java) AND engineer": [1, 2, 3, 8],
    "java NOT engineer": [4, 5],
    "NOT NOT java": [1, 4, 5, 8],
    "NOT (python OR java)": [6, 7],
    '"and"': [1, 7], '"AND"': [1, 7], "((R&D))": [7], "größe OR GRÖSSE": [8], "": [1, 2, 3, 4, 5, 6, 7, 8], "  ": [1, 2, 3, 4, 5, 6, 7, 8],
    'java"software engineer"': [1, 8], "and or not": [], "c.v": [],
}
WRONG = {
    '"software': "quote", "(java": "without its end", "java)": "without its start", "java AND": "missing", "AND java": "AND without",
    "NOT": "missing", "()": r"\) without", '""': "empty phrase", "java OR OR python": "OR without", "(java))": "start", 'a "b': "quote", "(a OR (b)": "end",
}


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "ord long, title string, description string")


def test_search_strings(rows):
    named = {f"s{i}": s for i, s in enumerate(SEARCHES)}
    got = with_searches(rows, named).collect()
    for name, search in named.items():
        assert [r["ord"] for r in got if r[name]] == SEARCHES[search], search
    assert [r["ord"] for r in matching(rows, "java NOT engineer").collect()] == [4, 5]
    assert matching(rows, "java").columns == rows.columns


@pytest.mark.parametrize("text", WRONG)
def test_unreadable_search_strings(rows, text):
    with pytest.raises(SearchError, match=WRONG[text]):
        matching(rows, text)


def test_search_strings_are_built_and_read_back(rows):
    built = conjunction(["software engineer", disjunction(["python", "java"]), negation("intern")])
    assert built == '"software engineer" AND (python OR java) AND (NOT intern)'
    assert [r["ord"] for r in matching(rows, built).collect()] == [8]
    assert negation(disjunction(["a b", "c"])) == 'NOT ("a b" OR c)'
    assert conjunction(["java"]) == "java" and conjunction(['"AND"']) == '"AND"' and disjunction(["a OR b"]) == "a OR b"


def plain_hits(rows, terms):
    return sorted((key, place) for key, *texts in rows for place, term in terms if term and any(
        t is not None and re.search(term, t, re.IGNORECASE) for t in texts))


TERMS = ["data", "engineer", "a", "c\\+\\+", "night shift", "ight shi", "x y z", "night  shift", " end", "ph\\.?d", "\\bsql\\b", "größe", "", "no\\.",
         "a.b", "data", "[xy]", "shift\nx", "on call on", "(?:one|two)", "1", "q y"]
TEXTS = [
    (1, "Data Engineer C++", "Night shift, on call on call"), (2, None, "night\nshift x y z"), (3, "fright shiny", None), (4, None, None), (5, "", ""),
    (6, "PHD", "sql;nosql 1a"), (7, "GRÖSSE größe", "the end"), (8, "x y", "z"), (9, "knight  shift", "shift\nx"), (10, "on", "call on"),
    (11, "data " * 3000, "x" * 5000), (12, "No.", "q yx"),
]


def test_hits_match_plain_search(spark):
    rows = spark.createDataFrame(TEXTS, "ord long, title string, description string")
    terms = spark.createDataFrame(list(enumerate(TERMS)), "place long, term string")
    for chosen in (terms, terms.where("term not rlike ' '"), terms.where("term = 'data'"), terms.where("false")):
        listed = [tuple(r) for r in chosen.collect()]
        for few in (0, 100):
            got = sorted(tuple(r) for r in keyword_hits(rows, chosen, "ord", few=few).collect())
            assert got == plain_hits(TEXTS, listed)
    assert keyword_hits(rows.where("false"), terms, "ord").count() == 0


def test_scores_are_those_of_the_scan(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 6))), " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(200)]
    scored = {w: [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(40)] + ["b+c", "\\bab"] for w in (2, 0, -1)}
    frame = spark.createDataFrame(rows, "ord long, title string, description string")
    got = keyword_scores(frame, term_table(spark, scored), "ord")
    wanted = with_keywords(frame, scored).select("ord", "keyword_score", "keywords")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_too_many_patterns(spark):
    terms = spark.range(600).selectExpr("id AS place", "concat('a.', id) AS term")
    with pytest.raises(ValueError):
        keyword_hits(spark.createDataFrame(TEXTS, "ord long, title string, description string"), terms, "ord")


def test_filter_lets_all_keys_and_few_others_through(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS key").union(spark.sql("SELECT CAST(NULL AS STRING)"))
    others = spark.range(200_000).selectExpr("concat('k', id) AS key").union(spark.sql("SELECT CAST(NULL AS STRING)"))
    blocks = key_filter.blocks_for(5000)
    through = key_filter.let_through(others, "key", key_filter.key_filter(keys, "key", blocks), blocks)
    assert through.columns == ["key"] and through.where("key is null").count() == 0
    assert through.join(keys, "key", "left_semi").count() == 5000
    assert through.count() <= 5000 + 195_000 * 0.002
    none = key_filter.let_through(others, "key", key_filter.key_filter(keys.where("false"), "key", 1), 1)
    assert none.count() == 0
    assert key_filter.blocks_for(10**12) == 0


def test_small_keys_leave_the_other_table_alone(spark):
    rows = spark.range(1000).selectExpr("concat('k', id) AS key")
    assert key_filter.thinned(rows, "key", rows, rows) is rows
    assert key_filter.thinned(rows, "key", rows.limit(10), rows).count() < 20


def posting(i, **changes):
    return {"ord": i, "id": f"p{i}", "job_url_direct": f"u{i}", "company": f"c{i}", "title": f"t{i}", "description": f"d{i}"} | changes


def test_what_is_shuffled_of_an_archive_follows_the_batch(spark, monkeypatch):
    schema = "ord long, id string, job_url_direct string, company string, title string, description string"
    archive = spark.createDataFrame([posting(i) for i in range(5000)], schema)
    batch = spark.createDataFrame([posting(9000, id="p7"), posting(9001, job_url_direct="u8"), posting(9002, company="c9", title="t9"),
                                   posting(9003, title="t10", description="d10"), posting(9004, id=None)], schema)
    old, new = raw_archive_leaves(archive), batch_leaves(batch)
    got = affected_leaves(old, new)
    assert sorted(r["_leaf"] for r in got.collect()) == ["r:10", "r:7", "r:8", "r:9"]
    seen = {}

    def watched(rows, column, built, blocks, let=key_filter.let_through):
        out = let(rows, column, built, blocks)
        seen[column] = out.count()
        return out

    monkeypatch.setattr(key_filter, "let_through", watched)
    affected_leaves(old, new)
    same = archive.where(F.col("ord") == 3).union(batch)
    assert sorted(r["id"] or "" for r in strict_anti(same, archive).collect()) == ["", "p7", "p9001", "p9002", "p9003"]
    assert 4 <= seen["_match"] <= 4 + 5000 * 4 * 0.002 and 1 <= seen["_same"] <= 1 + 5000 * 0.002
