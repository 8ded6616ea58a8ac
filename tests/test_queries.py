"""Every registered query against its SQL, on the smallest tables."""

import pytest

import oracle
from topshare.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_against_sql(spark, con, name):
    assert oracle.compare(spark, con, registry.QUERIES[name], registry.ORACLES[name], SF) == []


def test_every_query_has_sql_but_the_manifest():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"file_manifest"}


def test_manifest(spark):
    found = registry.QUERIES["file_manifest"](spark, SF).collect()
    assert {r["name"] for r in found} == {f"{t}.parquet" for t in oracle.TABLES}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
