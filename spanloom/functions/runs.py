"""Runs of equally tagged words as spans, in Arrow batches.

A text is cut, tagged and folded to spans without an object per character or word: lengths, starts and
runs are whole-column arithmetic over a slice of the batch, and only the spans go back to the JVM.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.schema import ENTITIES

SLICE = 8 * 1024 * 1024  # bytes of text worked on at a time

Tagger = Callable[[pa.Array, np.ndarray, np.ndarray, Sequence[pa.Array]], np.ndarray]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``SLICE`` bytes of text, one row at least."""

    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + SLICE, side="right")))
        yield first, last
        first = last


def _spans(texts: pa.Array, more: Sequence[pa.Array], labels: Sequence[str], tagger: Tagger) -> pa.Array:
    n = len(texts)
    pieces = pc.split_pattern(texts, " ")
    offsets = pieces.offsets.to_numpy().astype(np.int64)
    words = pieces.values
    sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    before = np.concatenate([[0], np.cumsum(sizes + 1)])  # characters and blanks ahead of each piece
    start = before[:-1] - before[offsets[row]]
    some = np.flatnonzero(sizes > 0)
    row, start, size, pos = row[some], start[some], sizes[some], some - offsets[row[some]]
    tags = tagger(words.take(pa.array(some)), row, pos, more)
    opens = np.ones(len(some), bool)
    opens[1:] = (row[1:] != row[:-1]) | (tags[1:] != tags[:-1])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(some))[: len(first)] - 1
    named = tags[first] > 0
    first, last = first[named], last[named]
    spans = pa.StructArray.from_arrays(
        [
            pa.array(labels, pa.string()).take(pa.array(tags[first].astype(np.int64) - 1)),
            pa.array(start[first]),
            pa.array(start[last] + size[last]),
        ],
        ["label", "start", "end"],
    )
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), spans, mask=pc.is_null(texts))


def runs(labels: Sequence[str], tagger: Tagger) -> Callable[..., pa.Array]:
    """A function of ``(texts, *more)`` that gives neighbouring space tokens of one tag as one entity.

    ``tagger`` gets the non-empty words of some texts, for each its row and its place among all pieces of the
    row, and the columns ``more``; it returns for each word 0 or the number of a label, from 1.
    """

    def entities(texts: pa.Array, *more: pa.Array) -> pa.Array:
        parts = [_spans(texts.slice(a, b - a), [m.slice(a, b - a) for m in more], labels, tagger) for a, b in _slices(texts)]
        return pa.concat_arrays(parts or [_spans(texts, more, labels, tagger)])

    return entities


def tagged_runs(labels: Sequence[str], tagger: Tagger) -> Callable[..., Column]:
    """``runs`` as a function of Columns."""

    # declared non-deterministic so that the optimizer never evaluates it twice
    return F.arrow_udf(runs(labels, tagger), ENTITIES).asNondeterministic()
