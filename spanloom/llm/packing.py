"""Best-fit packing of documents into sequences of several permitted lengths.

Variable-capacity best-fit: pieces fall in size into the open bin they fill best; when none has
room, the bin size of least cost per token is opened; at the end each bin shrinks to the smallest
permitted length that holds its contents.  Every set of lengths to open is tried on the same pieces
and the cheapest packing wins, so the lengths are optimised jointly.  A piece too large for all of a
set opens the smallest permitted length that holds it, so that long pieces rule out no set.
"""

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from itertools import chain, combinations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTHS = (512, 1024, 2048, 4096, 8192)
BIN_COST = 32.0
QUADRATIC = 1.0 / 65_536


def bin_cost(length: int) -> float:
    """Cost of one sequence: its tokens, attention that grows with the square, a fixed part."""

    return BIN_COST + length + QUADRATIC * length * length


def fill(sizes: Sequence[int], order: Sequence[int], lengths: Sequence[int], opened: Sequence[int]) -> tuple[list[list[int]], list[int]]:
    """Bins and their contents' sizes when ``opened`` are the lengths to open, ``order`` falling in size."""

    cheapest = sorted(opened, key=lambda n: (bin_cost(n) / n, -n))
    bins: list[list[int]] = []
    full: list[int] = []
    room: dict[int, list[int]] = {}  # open bins by what they have left
    rooms: list[int] = []  # the keys of room, rising
    for i in order:
        size = sizes[i]
        at = bisect_left(rooms, size)
        if at < len(rooms):
            left = rooms[at]
            b = room[left].pop()
            if not room[left]:
                del room[left]
                rooms.pop(at)
        else:
            left = next((n for n in cheapest if n >= size), None) or lengths[bisect_left(lengths, size)]
            b = len(bins)
            bins.append([])
            full.append(0)
        bins[b].append(i)
        full[b] += size
        left -= size
        if left:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append(b)
    return bins, full


def best_fit(sizes: Sequence[int], lengths: Sequence[int]) -> tuple[list[list[int]], list[int]]:
    """Bins (indices into ``sizes``) and their final lengths; no size may exceed the largest length."""

    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    best: tuple[float, list[list[int]], list[int]] = (float("inf"), [], [])
    for opened in chain.from_iterable(combinations(lengths, n) for n in range(1, len(lengths) + 1)):
        bins, full = fill(sizes, order, lengths, opened)
        final = [lengths[bisect_left(lengths, n)] for n in full]
        cost = sum(map(bin_cost, final))
        if cost < best[0]:
            best = (cost, bins, final)
    return best[1], best[2]


def pack_documents(
    docs: DataFrame, lengths: Sequence[int] = LENGTHS, block_rows: int = 20_000, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """One row per sequence: ``bin, length, used, items``.

    The token count of a document is its UTF-8 bytes and one end mark, as a byte-level model
    sees it; null and empty texts are one end mark.  A document longer than the largest length is cut:
    its first pieces are sequences of their own, the last piece is packed with the others.
    ``items`` are ``(id, piece, start, size, offset)``: token ``start`` of the document, ``offset`` in the
    sequence.  Each row of ``docs`` is packed once, also repeated rows and null identifiers.

    Identifiers and sizes, not texts, are packed where they are read, in blocks of at most
    ``block_rows`` neighbouring rows: nothing is shuffled whatever the keys, and a table in mixture
    order gives sequences in mixture order.  Only the last bins of a block are affected by
    the cut.  Identifiers may have any type.  ``bin`` names the task and the number of the sequence in it.  An empty table gives no
    sequence.
    """

    most = max(lengths)
    rows = docs.select(F.col(id_column).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"))
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, item = TaskContext.get().partitionId(), 0, None
        ids: list = []
        lasts: list[tuple[int, int, int]] = []
        done: list[tuple[int, int, list]] = []

        def emit(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            if len(done) >= least:
                names = [f"{task}-{number + i}" for i in range(len(done))]
                number += len(done)
                used, size, items = zip(*done, strict=True)
                columns = [pa.array(names), pa.array(size, pa.int32()), pa.array(used, pa.int64()), pa.array(items, pa.list_(item))]
                done.clear()
                yield pa.RecordBatch.from_arrays(columns, ["bin", "length", "used", "items"])

        def close() -> Iterator[pa.RecordBatch]:
            bins, final = best_fit([x[2] for x in lasts], lengths)
            for own, length in zip(bins, final, strict=True):
                offset, items = 0, []
                for i in own:
                    piece, start, size = lasts[i]
                    items.append((ids[i], piece, start, size, offset))
                    offset += size
                done.append((offset, length, items))
                yield from emit(1000)
            ids.clear()
            lasts.clear()

        for batch in batches:
            item = pa.struct([("id", batch.schema.field("id").type), *((n, pa.int64()) for n in ("piece", "start", "size", "offset"))])
            for key, size in zip(batch.column("id").to_pylist(), batch.column("size").to_pylist(), strict=True):
                cuts = (size - 1) // most
                for piece in range(cuts):
                    done.append((most, most, [(key, piece, piece * most, most, 0)]))
                    yield from emit(1000)
                ids.append(key)
                lasts.append((cuts, cuts * most, size - cuts * most))
                if len(ids) == block_rows:
                    yield from close()
        yield from close()
        yield from emit(1)

    return rows.mapInArrow(
        pack, f"bin string, length int, used long, items array<struct<id:{kind},piece:long,start:long,size:long,offset:long>>"
    )
