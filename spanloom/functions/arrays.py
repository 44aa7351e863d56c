"""Linear-time array helpers for work that stays inside one record.

A record (text plus spans) is one row, so anything that looks only at that row is
written with higher-order functions: no explode, no shuffle.  The helpers below
avoid the two traps of that style.  ``let`` binds an intermediate array once, where
a plain column reference could be inlined into a lambda and evaluated for every
element.  ``positions`` / ``running_sum`` / ``index_by_end`` replace the quadratic
"append to an accumulator" fold by flatten + filter passes.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def let(value: Column, body: Fn) -> Column:
    """Evaluate ``value`` once and use it (any number of times) in ``body``."""

    return F.transform(F.array(value), body)[0]


def positions(items: Column, wanted: Fn) -> Column:
    """0-based indexes of the items for which ``wanted`` holds."""

    marked = F.transform(items, lambda x, i: F.when(wanted(x), i).otherwise(F.lit(-1)))
    return F.filter(marked, lambda i: i >= 0)


def indexes(size: Column) -> Column:
    """``[0, 1, .. size - 1]``; empty for size 0."""

    return F.when(size > 0, F.sequence(F.lit(0), (size - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def running_sum(counts: Column) -> Column:
    """Inclusive running sum of non-negative integers."""

    ticks = F.flatten(
        F.transform(
            counts,
            lambda n: F.concat(F.array_repeat(F.lit(False), n.cast("int")), F.array(F.lit(True))),
        )
    )
    return F.transform(positions(ticks, lambda t: t), lambda p, j: (p - j).cast("bigint"))


def index_by_end(spans: Column) -> Column:
    """For each character c: index of the first span with ``end > c``.

    ``spans`` is sorted with non-decreasing ends; ``F.get`` past the last end is NULL.
    """

    def width(items: Column, s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(items, i - 1)["end"]).otherwise(F.lit(0))
        return (s["end"] - before).cast("int")

    return let(
        spans,
        lambda items: F.flatten(
            F.transform(items, lambda s, i: F.array_repeat(i, width(items, s, i)))
        ),
    )


def index_by_start(spans: Column, length: Column) -> Column:
    """For each character c: index of the last span with ``start <= c``, -1 if none."""

    def width(items: Column, s: Column, i: Column) -> Column:
        return (F.coalesce(F.get(items, i + 1)["start"], length) - s["start"]).cast("int")

    return let(
        spans,
        lambda items: F.concat(
            F.array_repeat(
                F.lit(-1), F.coalesce(F.get(items, F.lit(0))["start"], length).cast("int")
            ),
            F.flatten(F.transform(items, lambda s, i: F.array_repeat(i, width(items, s, i)))),
        ),
    )


def neighbours(items: Column, build: Callable[[Column, Column], Column]) -> Column:
    """``build(left, right)`` for each pair of adjacent items, NULL results dropped."""

    return let(
        items,
        lambda xs: F.filter(
            F.transform(xs, lambda right, i: F.when(i > 0, build(F.get(xs, i - 1), right))),
            lambda p: p.isNotNull(),
        ),
    )


def last_end(spans: Column) -> Column:
    """End of the last span, 0 without spans."""

    return F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0).cast("bigint"))
