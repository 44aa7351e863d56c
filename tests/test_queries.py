"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from workload.check import difference, open_tables

SF = contract.SMOKE_DIR
QUERIES, SQL = contract.queries(), contract.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def db():
    return open_tables(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    if name in SQL:
        assert difference(got, db.execute(SQL[name]).fetchdf()) is None


def test_entry_has_a_stable_schema(spark):
    assert contract.entry(spark).columns == ["scope", "metric", "value"]


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
