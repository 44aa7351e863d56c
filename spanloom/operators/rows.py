"""Unnesting of computed arrays."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, keep: list[str], items: Column | str, name: str | None = None) -> DataFrame:
    """One row per array element: the columns ``keep`` plus the element's fields.

    With ``name`` the element stays one column.  A plain ``explode`` makes the optimizer add
    a filter on the size of the array, which evaluates a computed array several times.  The
    outer form is evaluated once; the rows it adds for empty arrays are dropped behind it.
    """

    item = name or "item"
    rows = df.select(*keep, F.explode_outer(items).alias(item)).filter(F.col(item).isNotNull())
    return rows if name else rows.select(*keep, f"{item}.*")
