"""Every query with SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from attesta.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    mine = catalog.QUERIES[name](spark, SF)
    theirs = duck.sql(catalog.ORACLES[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine.columns, map(tuple, mine.collect())) == rows(theirs.columns, theirs.fetchall())


def test_sidecars_are_yaml(spark):
    import yaml

    for r in catalog.QUERIES["yaml_sidecars"](spark, SF).limit(5).collect():
        assert yaml.safe_load(r["sidecar"])["source_file_path"] == r["source_file_path"]


def test_every_query_has_sql_but_rendered_yaml():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"yaml_sidecars"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down_and_prune(spark):
    plan = catalog.QUERIES["status_gate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan
    chunks = catalog.QUERIES["chunk_documents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in chunks and "Python" not in chunks
