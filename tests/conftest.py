import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from spanloom.schema import ENTITIES_DDL  # noqa: E402
from workload.session import local_session  # noqa: E402

RECORD = f"ord bigint, hash string, text string, entities {ENTITIES_DDL}"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests")


@pytest.fixture(scope="session")
def make(spark):
    """Records from ``(hash, text, [(label, start, end), ...])``."""

    def build(*rows):
        return spark.createDataFrame(
            [(i, h, t, None if e is None else [tuple(x) for x in e]) for i, (h, t, e) in enumerate(rows)], RECORD
        )

    return build


@pytest.fixture(scope="session")
def ev(spark):
    """Evaluate Columns against one row of values."""

    def run(values, *columns):
        schema = ", ".join(f"{k} {v[1]}" for k, v in values.items())
        df = spark.createDataFrame([tuple(v[0] for v in values.values())], schema)
        row = df.select(*columns).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return run
