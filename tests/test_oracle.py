"""Each core query against its SQL, on the smallest test data."""

import os

import duckdb
import pytest

from loomdex.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{f}')")
    return c


def plain(v):
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else round(v, 8) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, db, name):
    df = registry.QUERIES[name](spark, FOLDER)
    rows = df.toArrow().to_pylist()
    said = db.execute(registry.SQL[name])
    columns = [x[0] for x in said.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr([plain(r[c]) for c in columns]) for r in rows) == sorted(repr([plain(v) for v in r]) for r in said.fetchall())


def test_every_query_has_sql_or_python_in_it():
    assert set(registry.QUERIES) - set(registry.SQL) == {"parse_symbols", "symbol_kinds", "semantic_chunks", "chunk_embeddings"}
