"""Named queries against their DuckDB counterparts on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF
from rolecall.queries import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"clean_description"}
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = Counter(tuple(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect())
    assert got
    if name in ORACLES:
        result = db.sql(ORACLES[name])
        assert sorted(result.columns) == columns
        wanted = result.project(", ".join(f'"{c}"' for c in columns)).fetchall()
        assert got == Counter(wanted)
