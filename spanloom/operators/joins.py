"""Lookup joins against a side that may or may not be small."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024


def lookup_join(
    rows: DataFrame, table: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Join ``rows`` to a lookup ``table`` with unique keys.

    The table is broadcast only after measuring that it has at most ``limit`` rows and
    ``BROADCAST_BYTES`` of content.  A larger one is joined by shuffle; a key that a third of the rows
    carry makes a skewed partition there, which adaptive execution splits.
    """

    return rows.join(F.broadcast(table) if is_small(table, limit) else table, on, how)


def is_small(table: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Measured, not estimated: few enough rows and bytes to copy to every executor.

    A table that ends in an aggregate is computed for this, so callers materialize it.
    """

    size = F.octet_length(F.to_json(F.struct(*table.columns)))
    rows, content = table.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= limit and content <= BROADCAST_BYTES
