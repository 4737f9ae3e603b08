"""Every query beside its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from cartolith.plans import registry
from check_oracles import rows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, db, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(db.execute(registry.ORACLES[name]).df())


def test_every_query_runs(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLES)):
        assert registry.QUERIES[name](spark, SF).columns


def test_entry_points(spark, monkeypatch):
    """The entry module offers the registry's queries with or without the training-data subpackage."""
    import importlib.util

    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("cartolith.llm", "corpus_pipeline") else find(name, *a))
    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.ORACLES)
    assert entry.entry(spark).columns == ["z", "tx", "ty", "id", "category", "importance", "is_leaf"]
