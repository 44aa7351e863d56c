"""Greedy choice of non-overlapping spans inside one array.

Kept spans are disjoint, so in start order their ends rise too, and a new span meets one of them
exactly when it meets the last that starts before its end.  The islands of a table arrive in order and are
chosen from in Arrow batches: those of one size at once, each span against every better one, and an island
beyond ``LARGE`` looks its neighbour up in an ordered set.  A record's small islands are folded in the JVM.
"""

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.arrays import let, positions

LARGE = 32  # spans of an island
LARGE_RECORD = 512  # spans of a record, whose islands are not known before they are cut


def spans_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open intervals share at least one character."""

    return (a_start < b_end) & (b_start < a_end)


def disjoint_flags(starts: list[int], ends: list[int]) -> list[bool]:
    """Which spans are kept when each is taken in turn unless it meets a kept one."""

    kept_starts: list[int] = []
    kept_ends: list[int] = []
    flags = []
    for start, end in zip(starts, ends, strict=True):
        at = bisect_left(kept_starts, end)  # those before start ahead of the end
        free = at == 0 or kept_ends[at - 1] <= start
        if free:
            kept_starts.insert(at, start)
            kept_ends.insert(at, end)
        flags.append(free)
    return flags


def _flags_batch(starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series(
        [None if a is None else disjoint_flags(a.tolist(), b.tolist()) for a, b in zip(starts, ends, strict=True)],
        dtype=object,
    )


# declared non-deterministic so that the optimizer never evaluates it twice
_flags = F.pandas_udf(_flags_batch, T.ArrayType(T.BooleanType())).asNondeterministic()


def _keep_large(ordered: Column, large: Column) -> Column:
    """The kept ones of ``ordered`` spans, best first, where ``large``; elsewhere NULL."""

    starts = F.transform(ordered, lambda s: s["start"].cast("bigint"))
    ends = F.transform(ordered, lambda s: s["end"].cast("bigint"))
    both = F.arrays_zip(ordered, _flags(F.when(large, starts), F.when(large, ends)))
    return F.transform(F.filter(both, lambda z: z["1"]), lambda z: z["0"])


def _keep_small(spans: Column) -> Column:
    none = F.filter(spans, lambda s: F.lit(False))
    folded = F.aggregate(
        F.sort_array(spans),
        none,
        lambda kept, s: F.when(
            F.exists(kept, lambda k: spans_overlap(k["start"], k["end"], s["start"], s["end"])), kept
        ).otherwise(F.concat(kept, F.array(s))),
    )
    return F.when(F.size(spans) < 2, spans).otherwise(folded)


NONE = np.iinfo(np.int64).min


def _bounds(rows: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """A bound of all spans, NULL as ``NONE``."""

    return pc.fill_null(rows[name].cast(pa.int64()), NONE).to_numpy(zero_copy_only=False)


def _opens(starts: np.ndarray, ends: np.ndarray, nth: np.ndarray, reach: int) -> tuple[np.ndarray, int]:
    """Which spans begin where all earlier ones of their group have ended, and how far the last group reaches.

    The groups follow each other in start order; the first of them has reached ``reach`` before.
    """

    group = np.concatenate([[0], np.cumsum(nth == 1)])
    values, ranks = np.unique(np.concatenate([[reach], ends]), return_inverse=True)
    upto = values[np.maximum.accumulate(ranks + group * len(values)) - group * len(values)]
    before = upto[:-1]
    return (nth == 1) | (starts == NONE) | (before == NONE) | (starts >= before), int(upto[-1])


def _choose(islands: np.ndarray, starts: np.ndarray, ends: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Which spans of whole islands are kept; one with a NULL bound meets none."""

    keep = np.ones(len(islands), bool)
    known = np.flatnonzero((starts != NONE) & (ends != NONE))
    known = known[np.lexsort((best[known], islands[known]))]
    opens = np.ones(len(known), bool)
    opens[1:] = islands[known][1:] != islands[known][:-1]
    first = np.flatnonzero(opens)
    sizes = np.diff(np.append(first, len(known)))
    for size in np.unique(sizes[sizes > 1]).tolist():
        at = known[first[sizes == size][:, None] + np.arange(size)]  # an island a row, best first
        a, b = starts[at], ends[at]
        if size > LARGE:
            keep[at] = [disjoint_flags(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            continue
        kept = np.ones(at.shape, bool)
        for k in range(1, size):
            kept[:, k] = ~(kept[:, :k] & (a[:, :k] < b[:, k : k + 1]) & (a[:, k : k + 1] < b[:, :k])).any(axis=1)
        keep[at] = kept
    return keep


def kept_rows(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of Arrow batches that gives ``columns`` of the spans that are kept.

    The batches hold whole groups in start order with ``start``, ``end``, the place ``nth`` in the group (from 1) and
    the place ``best`` in the order of choice.  An island may go on in the next batch, which is then waited for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        reach = NONE

        def close(parts: list[pa.RecordBatch], islands: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts)
            keep = _choose(np.concatenate(islands), _bounds(rows, "start"), _bounds(rows, "end"), rows["best"].to_numpy())
            yield from rows.select(columns).filter(pa.array(keep)).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            opens, reach = _opens(_bounds(batch, "start"), _bounds(batch, "end"), batch["nth"].to_numpy(), reach)
            first = np.flatnonzero(opens)
            if len(first):
                islands = [np.zeros(sum(w.num_rows for w in waiting), np.int64), np.cumsum(opens)[: first[-1]]]
                if len(islands[0]) + len(islands[1]):
                    yield from close([*waiting, batch.slice(0, first[-1])], islands)
                waiting = []
            waiting.append(batch.slice(first[-1] if len(first) else 0))
        if waiting:
            yield from close(waiting, [np.zeros(sum(w.num_rows for w in waiting), np.int64)])

    return run


def keep_disjoint(spans: Column, rank: Callable[[Column], list[Column]]) -> Column:
    """Greedy choice over a record's array of ``struct<label,start,end>``.

    The array is cut into islands of transitively overlapping spans.  In start order
    span i opens an island exactly when the i earlier spans have all ended, that is
    when the i-th smallest end is not past its start; two sorts find every cut.
    ``rank`` may read ``idx``, the place of a span in the given array.
    """

    def ranked(e: Column) -> Column:
        order = [r.alias(f"p{i}") for i, r in enumerate(rank(e))]
        return F.struct(
            *order, e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end")
        )

    by_start = F.sort_array(
        F.transform(
            spans,
            lambda e, i: F.struct(
                e["start"].alias("start"),
                e["end"].alias("end"),
                e["label"].alias("label"),
                i.alias("idx"),
            ),
        )
    )
    ends = F.sort_array(F.transform(spans, lambda e: e["end"]))

    def islands(sorted_spans: Column, sorted_ends: Column, cuts: Column) -> Column:
        return F.flatten(
            F.transform(
                cuts,
                lambda first, k: _keep_small(
                    F.transform(
                        F.slice(
                            sorted_spans,
                            first + 1,
                            F.coalesce(F.get(cuts, k + 1), F.size(sorted_spans)) - first,
                        ),
                        ranked,
                    )
                ),
            )
        )

    def opens(sorted_spans: Column, sorted_ends: Column) -> Column:
        return positions(
            F.transform(
                sorted_spans, lambda s, i: (i == 0) | (F.get(sorted_ends, i - 1) <= s["start"])
            ),
            lambda flag: flag,
        )

    # a record of no more spans has no larger island
    large = F.coalesce(F.size(spans) > LARGE_RECORD, F.lit(False))
    small = let(
        by_start,
        lambda s: let(ends, lambda z: let(opens(s, z), lambda cuts: islands(s, z, cuts))),
    )
    kept = F.when(large, _keep_large(F.sort_array(F.transform(by_start, ranked)), large)).otherwise(small)
    return F.sort_array(
        F.transform(
            kept,
            lambda e: F.struct(
                e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label")
            ),
        )
    )


def longest_first(e: Column) -> list[Column]:
    """Rank for nested source annotations: longest, then start, end, order of arrival."""

    return [e["start"] - e["end"], e["start"], e["end"], e["idx"]]
