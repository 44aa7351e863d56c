"""Every query of the package, and its SQL where there is one, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from spanloom.llm.queries import QUERIES, SQL
from workload.check import difference, open_tables

pytestmark = pytest.mark.skipif(not Path(contract.SMOKE_DIR).is_dir(), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, contract.SMOKE_DIR).toPandas()
    assert difference(got, open_tables(contract.SMOKE_DIR).execute(SQL[name]).fetchdf()) is None


def test_registered():
    assert {f"op{i}_" for i in range(1, 14)} == {q.split("_")[0] + "_" for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
