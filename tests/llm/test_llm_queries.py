"""The registered queries against DuckDB, and the pipeline against a plain version of its decisions."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from conftest import SF
from rolecall.llm import decontaminate, langid, near, repeats
from rolecall.llm.common import held_out
from rolecall.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = Counter(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    assert got
    if name in ORACLES:
        result = db.sql(ORACLES[name])
        assert sorted(result.columns) == columns
        assert got == Counter(result.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_texts_are_restored(spark):
    rows = QUERIES["op2_sentencepiece"](spark, SF)
    assert rows.where("not restored").count() == 0


def test_pipeline_keeps_columns_and_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:len(docs.columns)] == docs.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows and all(r["decoded"] == r["text"] for r in rows.values())
    named = langid.identify(docs, langid.train(docs.where(~held_out()).select("text", "lang")))
    identified = docs.join(named.where("lang_pred <> 'und' and bits_per_byte <= 8").select("doc_id"), "doc_id")
    kept = identified.join(near.groups(identified).where("doc_id = component_id").select("doc_id"), "doc_id")
    cut = repeats.summaries(kept).where("n_removed = 0 or n_removed < n_words").select("doc_id")
    leaks = decontaminate.find(kept.join(cut, "doc_id"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    whole = {r["doc_id"] for r in leaks.where("size(item_ids) = 0").collect()}
    assert whole <= set(rows) <= {r["doc_id"] for r in cut.collect()}


ODD = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "the cat sat on the mat " * 30, "en", "s", 1), (3, "the cat sat on the mat " * 30, "en", "s", 1),
       (4, "The Cat sat on the mat " * 30, None, None, None), (None, "the hat", "en", "s", 7), (5, "1 2 3", "en", "s", 5)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_odd_rows(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, decoded int, mark string, _runs int"
    docs = spark.createDataFrame([(*r, 1, "m", 2) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.collect()
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == ([3, None] if rows else [])
