"""Agreement pieces of two sides of a text, in Arrow batches.

The spans of a slice of the batch share one axis, on which each text has a place of its own: edges are sorted and
looked up as whole columns.  Pieces tile their texts, so their bytes are those of the texts, cut at new offsets.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.runs import _slices

STATUSES = pa.array(["correct", "boundary_error", "missed", "false_positive"])  # by code, from 1
ROWS = 64 * 1024  # of an output batch

PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("status", T.StringType()),
            T.StructField("piece", T.StringType()),
        ]
    )
)

_FIELDS = [("start", pa.int64()), ("end", pa.int64()), ("status", pa.string()), ("piece", pa.string())]


class _Side:
    """The spans of one side on the axis; a text with a NULL end is covered by none of its spans."""

    def __init__(self, entities: pa.Array, base: np.ndarray, length: np.ndarray):
        counts = pc.fill_null(pc.list_value_length(entities), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        spans = entities.flatten()
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.label = pc.struct_field(spans, "label")
        starts, ends = (pc.struct_field(spans, name).cast(pa.int64()) for name in ("start", "end"))
        lost = pc.is_null(ends).to_numpy(zero_copy_only=False)
        self.start = pc.fill_null(starts, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        self.end = end = pc.fill_null(ends, 0).to_numpy(zero_copy_only=False)
        # of spans that overlap, the first that ends behind a character covers it
        before = np.concatenate([[0], end])[:-1]
        opens = np.concatenate([[0], np.cumsum(counts)])[:-1]
        before[opens[counts > 0]] = 0
        upto = np.concatenate([[0], np.cumsum(np.maximum(end - before, 0))])
        reach = upto[1:] - upto[opens[self.row]]
        reach[np.bincount(self.row[lost], minlength=len(counts))[self.row] > 0] = 0
        self.reach = base[self.row] + np.minimum(reach, length[self.row])
        edges = [(self.row[ok], at[ok]) for at in (self.start, end) for ok in [(at >= 0) & (at < length[self.row])]]
        self.edges = np.concatenate([base[row] + at for row, at in edges])

    def covering(self, place: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of the span at each place, -1 if none."""

        if not len(self.row):
            return np.full(len(place), -1)
        found = np.searchsorted(self.reach, place, side="right")
        span = np.minimum(found, len(self.row) - 1)
        return np.where((found == span) & (self.row[span] == row) & (self.start[span] <= at), span, -1)


def _pieces(texts: pa.Array, gold: pa.Array, pred: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """The row of each piece and the pieces, in order; a row with a NULL has none."""

    whole = pc.and_(pc.and_(pc.is_valid(texts), pc.is_valid(gold)), pc.is_valid(pred))
    texts = pc.if_else(whole, texts, "").cast(pa.large_string())
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.concatenate([[0], np.cumsum(length)])  # ahead of each text
    base = chars[:-1] + np.arange(len(length))
    sides = [_Side(s, base, length) for s in (gold, pred)]
    place = np.unique(np.concatenate([base[length > 0], *[s.edges for s in sides]]))
    row = np.searchsorted(base, place, side="right") - 1
    at = place - base[row]
    g, p = (s.covering(place, row, at) for s in sides)
    codes = pa.concat_arrays([s.label.cast(pa.string()) for s in sides]).dictionary_encode().indices
    codes = pc.fill_null(codes.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    labels = codes[: len(sides[0].row)], codes[len(sides[0].row) :]
    both = np.flatnonzero((g >= 0) & (p >= 0))
    facts = [[values[i[both]] for values in (names, s.start, s.end)] for s, names, i in zip(sides, labels, (g, p), strict=True)]
    same = np.zeros(len(place), bool)
    same[both] = (facts[0][0] >= 0) & np.all([a == b for a, b in zip(*facts, strict=True)], axis=0)
    status = np.where((g >= 0) & (p >= 0), np.where(same, 1, 2), np.where(g >= 0, 3, np.where(p >= 0, 4, 0)))
    opens = np.ones(len(place), bool)
    opens[1:] = (row[1:] != row[:-1]) | (status[1:] != status[:-1])
    first = np.flatnonzero(opens)
    row, start, status = row[first], at[first], status[first]
    end = length[row]
    inner = np.flatnonzero(row[1:] == row[:-1])
    end[inner] = start[inner + 1]
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    cuts = chars[row] + start
    if len(raw) > chars[-1]:
        cuts = np.flatnonzero((raw & 0xC0) != 0x80)[cuts]
    cuts = np.append(cuts, len(raw)).astype(np.int64)
    piece = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(cuts), pa.py_buffer(raw))
    columns = [
        pa.array(start),
        pa.array(end),
        STATUSES.take(pa.array(status - 1, mask=status == 0)),
        piece.cast(pa.string()),
    ]
    return row, pa.StructArray.from_arrays(columns, PIECES.elementType.names)


def _pieces_array(texts: pa.Array, gold: pa.Array, pred: pa.Array) -> pa.Array:
    lists = []
    for a, b in _slices(texts):
        part = [c.slice(a, b - a) for c in (texts, gold, pred)]
        row, pieces = _pieces(*part)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))]).astype(np.int32)
        none = pc.or_(pc.or_(*[pc.is_null(c) for c in part[:2]]), pc.is_null(part[2]))
        lists.append(pa.ListArray.from_arrays(pa.array(ends), pieces, mask=none))
    return pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.struct(_FIELDS)))


# declared non-deterministic so that the optimizer never evaluates it twice
_agreement = F.arrow_udf(_pieces_array, PIECES).asNondeterministic()


def agreement_pieces(text: Column, gold: Column, pred: Column) -> Column:
    """``array<struct<start,end,status,piece>>`` of one text; both sides are sorted and free of overlaps."""

    return _agreement(text, gold, pred)


def piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(hash, start, end, status, piece)`` from batches of ``(hash, text, gold, pred)``."""

    for batch in batches:
        keys, texts, gold, pred = batch.columns
        for a, b in _slices(texts):
            row, pieces = _pieces(*[c.slice(a, b - a) for c in (texts, gold, pred)])
            named = [keys.slice(a, b - a).take(pa.array(row)), *pieces.flatten()]
            found = pa.RecordBatch.from_arrays(named, ["hash", *PIECES.elementType.names])
            for at in range(0, len(row), ROWS):
                yield found.slice(at, ROWS)
