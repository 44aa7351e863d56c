"""Words and word windows of a batch of texts as numpy arrays.

Words are the maximal runs of bytes outside ``\\x20\\x09-\\x0D``; all texts of a batch are
handled at once on their UTF-8 bytes, so the cost does not depend on the number of texts.
Hashes depend on the bytes of the word alone: 64 bits, mixed in again after every eight bytes.
No sum of powers is used, whose collisions some words (Thue-Morse) have for every base.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
CHUNKED = 512  # longer ranges are hashed one by one
TAIL = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)  # the bytes of a chunk that count


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits (a bijection)."""

    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(text: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts joined, and the ``n + 1`` offsets of the texts; null is empty."""

    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
    text = pc.fill_null(text.cast(pa.large_string()), "")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if text.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a per-byte (or per-word) array over the rows given by ``offsets``."""

    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return np.diff(total[offsets])


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges ``[start, end)``, equal for equal bytes."""

    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    length = ends - starts
    out = mix(length.astype(np.uint64) * np.uint64(BASE))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from every place
    left = np.flatnonzero((length > 0) & (length <= CHUNKED))
    at, rest = starts[left], length[left]
    while len(left):
        out[left] = mix(out[left] ^ (eight[at] & TAIL[np.minimum(rest, 8)]))
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    for i in np.flatnonzero(length > CHUNKED):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, "<u8")[0]
    return out


@dataclass
class Words:
    """Words of the texts of a batch: ``rows`` are the offsets of each text's words."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return range_hashes(LOWER[self.data] if lower else self.data, self.starts, self.ends)


def words_of(text: pa.Array | pa.ChunkedArray) -> Words:
    data, offsets = text_bytes(text)
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)  # where a text begins, or the data end
    first[offsets] = True
    begin, stop = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1] | first[1:-1]
        stop[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begin)
    return Words(data, offsets, starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, rows: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words that lie in one text.

    Returns them with the index of their first word and the offsets of each text's windows.
    With ``short`` the whole word sequence of a text with 1 to k-1 words is its one window.
    """

    counts = np.diff(rows)
    n = len(hashes)
    # the order of the words counts: each is mixed in on top of those before it
    total = np.full(n, np.uint64(k))
    for j in range(k):
        m = max(n - j, 0)
        total[:m] = mix(total[:m] ^ hashes[j:])
    per = np.maximum(counts - k + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - rows[:-1][owner]
    whole = place + k <= counts[owner]
    if short:
        few = np.flatnonzero((counts > 0) & (counts < k))
        for r in few:  # at most k-1 words each
            a, b = rows[r], rows[r + 1]
            one = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                one = mix(one ^ h)
            total[a] = one[0]
            whole[a] = True
        per[few] = 1
    index = np.flatnonzero(whole)
    return total[index], index, np.concatenate(([0], np.cumsum(per)))
