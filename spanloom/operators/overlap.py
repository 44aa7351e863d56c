"""Overlap predicates, overlap joins and greedy overlap resolution.

``overlap_join`` meets spans on ``(hash, cell)``, a cell being a fixed stretch of
characters, so it compares a span with its neighbourhood and not with everything in
the document.  ``keep_greedily`` cuts each document into islands of transitively
overlapping spans: spans of different islands never compete, so the sequential
choice is made per island.  Spark ranks and sorts the spans of a document, and tasks stream
them in that order, an island at a time.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.greedy import kept_rows, spans_overlap

CELL = 512


def overlap_join(left: DataFrame, right: DataFrame, key: str = "hash", cell: int = CELL) -> DataFrame:
    """Overlapping pairs of two span tables; right columns get the prefix ``other_``."""

    def celled(df: DataFrame, start: str, end: str) -> DataFrame:
        first = F.floor(F.col(start) / cell)
        last = F.floor((F.col(end) - 1) / cell)
        return df.withColumn("cell", F.explode(F.sequence(first, last)))

    a = celled(left, "start", "end")
    b = celled(
        right.select(key, *[F.col(c).alias(f"other_{c}") for c in right.columns if c != key]),
        "other_start",
        "other_end",
    )
    pairs = a.join(b, [key, "cell"]).filter(
        spans_overlap(F.col("start"), F.col("end"), F.col("other_start"), F.col("other_end"))
        # a pair sharing several cells is kept once, in the first of them
        & (F.col("cell") == F.floor(F.greatest("start", "other_start") / cell))
    )
    return pairs.drop("cell")


def keep_greedily(spans: DataFrame, priority: list[Column], keys: list[str]) -> DataFrame:
    """Keep spans best first, skipping any that overlaps a kept one.

    ``spans`` has ``keys``, ``label``, ``start``, ``end`` and whatever ``priority``
    (ascending, best first) reads.  Returns the kept ``keys + label, start, end``.
    """

    columns = [*keys, "label", "start", "end"]
    group = W.partitionBy(*keys)
    best = F.row_number().over(group.orderBy(*priority, "label", "start", "end"))
    ranked = spans.withColumn("best", best).select(*columns, "best")
    placed = ranked.withColumn("nth", F.row_number().over(group.orderBy("start")))
    # the order of the window, which Spark does not sort for again
    ordered = placed.sortWithinPartitions(*keys, "start")
    return ordered.mapInArrow(kept_rows(columns), ranked.select(*columns).schema)


def drop_overlaps_longest(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Longest first, ties by start then end; overlapped spans are dropped.

    Where two labels share one interval the order of arrival decides: ``idx`` if
    the table has it, else the label.
    """

    arrival = F.col("idx") if "idx" in spans.columns else F.col("label")
    return keep_greedily(
        spans, [F.col("start") - F.col("end"), F.col("start"), F.col("end"), arrival], keys or ["hash"]
    )


def select_non_overlapping(candidates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Highest score first, then earliest, longest, label; overlapped ones are skipped."""

    return keep_greedily(
        candidates,
        [-F.col("score"), F.col("start"), F.col("start") - F.col("end"), F.col("label")],
        keys or ["hash"],
    )
