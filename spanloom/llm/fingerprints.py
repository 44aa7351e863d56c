"""Document fingerprints: improbable byte windows in chained Bloom filters.

Every 64-byte window of a text has an entropy; the rarer that entropy is in the corpus, the
lower the window's rank.  In each neighbourhood of 64 windows the leftmost lowest rank wins; windows that
win often are the features.  They are inserted, 160 to a filter, into a chain of 2,048-bit
Bloom filters, and two chains are compared by the overlap of their bits beyond chance.
"""

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrays import mix, range_hashes, text_bytes
from spanloom.llm.stage import parts

WINDOW = 64
NEIGHBOURS = 64
POPULARITY = 16
LEVELS = 1001
WEAKEST, STRONGEST = 100, 990  # entropies of at most / beyond these levels tell nothing
FILTER_BITS = 2048
FILTER_FEATURES = 160
PROBES = 5
SLICE_BYTES = 1_000_000
CHUNK = 1 << 17
LOWEST = -(1 << 63)
MAX_BLOCKS = 1 << 16

_count = np.arange(1, WINDOW + 1)
# entropy share of a byte value seen 0..64 times in a window, as integers so that sums are exact
SHARE = np.concatenate(([0], np.rint((1 << 20) * _count / WINDOW * np.log2(WINDOW / _count)))).astype(np.int64)
STEP = np.diff(SHARE)


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Level 0..1000 of the entropy of each 64-byte window of ``data``.

    The entropy is carried from window to window: the byte that leaves and the one that enters
    change it by an amount that depends only on how often they occur in the window.
    """

    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for start in range(0, n, CHUNK):
        stop = min(n, start + CHUNK + WINDOW)
        piece = data[start:stop]
        own, before = np.zeros(len(piece), np.uint8), np.zeros(len(piece), np.uint8)
        for d in range(1, min(WINDOW, len(piece))):
            same = (piece[:-d] == piece[d:]).view(np.uint8)
            own[:-d] += same
            before[d:] += same
        size = min(CHUNK, n - start)
        ahead[start : start + size] = own[:size]
        first = 0 if start == 0 else WINDOW  # the chunk before has these
        behind[start + first : stop] = before[first:]
    change = STEP[behind[WINDOW:]] - STEP[ahead[: n - WINDOW]]
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = SHARE[np.bincount(data[:WINDOW], minlength=256)].sum()
    np.cumsum(change, out=total[1:])
    total[1:] += total[0]
    return total * 1000 // (6 << 20)


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which windows of the joined bytes lie within one text."""

    edge = np.zeros(n + 1, np.int32)
    sizes = np.diff(offsets)
    full = sizes >= WINDOW
    np.add.at(edge, offsets[:-1][full], 1)
    np.add.at(edge, offsets[1:][full] - WINDOW + 1, -1)
    return np.cumsum(edge)[: max(n - WINDOW + 1, 0)] > 0


def entropy_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy level, the rarest in all windows of all texts first.

    Tasks count, Spark sums: at most 1,001 rows come back, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for a, b in parts(batch.column("text"), SLICE_BYTES):
                data, offsets = text_bytes(batch.column("text").slice(a, b - a))
                total += np.bincount(entropy_levels(data)[_inside(offsets, len(data))], minlength=LEVELS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["level", "n"])

    rows = docs.select("text").mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n")).collect()
    seen = np.zeros(LEVELS, np.int64)
    for level, n in rows:
        seen[level] = n
    ranks = np.empty(LEVELS, np.int64)
    ranks[np.argsort(seen, kind="stable")] = np.arange(LEVELS)
    return ranks


def fingerprints(text: pa.Array, ranks: np.ndarray) -> list[np.ndarray]:
    """Chains of Bloom filters, one ``(filters, 256)`` byte matrix per text.

    A text without a telling window (shorter than 64 bytes, or monotonous) has its whole
    content as its one feature; null and empty texts have no filter.
    """

    data, offsets = text_bytes(text)
    n, levels = len(data), entropy_levels(data)
    allowed = _inside(offsets, n) & (levels > WEAKEST) & (levels <= STRONGEST)
    bits = max(n, 1).bit_length()
    kind = np.uint32 if bits + 10 <= 32 else np.uint64
    none = np.iinfo(kind).max
    key = np.full(NEIGHBOURS - 1 + n, none, kind)  # windows that cross texts separate the neighbourhoods
    at = np.flatnonzero(allowed)
    key[at + NEIGHBOURS - 1] = (ranks[levels[at]].astype(kind) << kind(bits)) | at.astype(kind)
    lowest = key
    for d in (1, 2, 4, 8, 16, 32):
        lowest = np.minimum(lowest, np.concatenate((lowest[d:], np.full(d, none, kind))))
    winner = (lowest[lowest != none] & kind((1 << bits) - 1)).astype(np.int64)
    chosen = np.flatnonzero(np.bincount(winner, minlength=n) >= POPULARITY)
    owner = np.searchsorted(offsets, chosen, "right") - 1
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    bare = np.flatnonzero((counts == 0) & (np.diff(offsets) > 0))
    begin = np.concatenate((chosen, offsets[bare]))
    hashes = range_hashes(data, begin, np.concatenate((chosen + WINDOW, offsets[bare + 1])))
    owner = np.concatenate((owner, bare))
    place = np.concatenate((np.arange(len(chosen)) - np.concatenate(([0], np.cumsum(counts)))[owner[: len(chosen)]], np.zeros(len(bare), np.int64)))
    counts[bare] = 1
    base = np.concatenate(([0], np.cumsum(-(-counts // FILTER_FEATURES))))
    bloom = np.zeros((base[-1], FILTER_BITS), bool)
    row = base[owner] + place // FILTER_FEATURES
    hashes = mix(hashes)
    for j in range(PROBES):
        bloom[row, (hashes >> np.uint64(11 * j)).astype(np.int64) & (FILTER_BITS - 1)] = True
    packed = np.packbits(bloom, axis=1)
    return [packed[base[i] : base[i + 1]] for i in range(len(counts))]


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain with its best match, averaged.

    The overlap of two filters is what exceeds the bits expected by chance, as a share of the
    most there could be.  Two empty chains are alike, an empty and another are not.
    """

    if len(one) == 0 or len(two) == 0:
        return float(len(one) == len(two))
    if one.shape == two.shape and (one == two).all():
        return 1.0
    if len(one) > len(two):
        one, two = two, one
    long, own = two.view(np.uint64), np.bitwise_count(two.view(np.uint64)).sum(1).astype(float)
    total = 0.0
    for row in one.view(np.uint64):
        mine = float(np.bitwise_count(row).sum())
        shared = np.bitwise_count(row & long).sum(1)
        chance, most = mine * own / FILTER_BITS, np.minimum(mine, own)
        total += float(np.max((shared - chance) / (most - chance)))
    return min(max(total / len(one), 0.0), 1.0)


def encode(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


RESULT = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def fingerprint_documents(docs: DataFrame, ranks: np.ndarray | None = None, block_rows: int = 2_000) -> DataFrame:
    """Fingerprints of each text and of its edited text, compared (``doc_id`` and ``RESULT``).

    The edited text has its last ``n_chars // 2`` code points replaced by as many (or all) of
    the first of the next document by falling ``doc_id``, the first following the last.  Null texts count as empty,
    null identifiers come last; rows of one identifier follow each other by digest of the text.

    The identifiers, whole numbers or of a type with a text form, are cut into blocks of about ``block_rows``, at
    most ``MAX_BLOCKS`` of them; the row that begins a block is also sent to the block before, so each text is
    shuffled once and blocks are independent.  A block is a stream: its size does not matter.
    """

    ranks = entropy_ranks(docs) if ranks is None else ranks
    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)) if whole else F.coalesce(F.concat(F.lit("1"), F.col("doc_id").cast("string")), F.lit("0"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), own.alias("key"))
    blocks = min(max(1, -(-rows.count() // block_rows)), MAX_BLOCKS)
    # one row per block: its largest identifier, which begins it
    dealt = rows.select("key").repartitionByRange(blocks, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.max("key").alias("key"))
    borders = sorted(r["key"] for r in dealt.collect()) or [LOWEST if whole else "0"]
    starts = np.array(borders, np.int64 if whole else object)  # rising; block 0 is the last here
    shared = docs.sparkSession.sparkContext.broadcast(starts)

    @F.pandas_udf("int")
    def block_of(key: pd.Series) -> pd.Series:
        return pd.Series(len(shared.value) - 1 - np.searchsorted(shared.value, key.to_numpy(), "left"), dtype="int32")

    count = len(starts)
    placed = (
        rows.withColumn("block", block_of("key"))
        .withColumn("begins", _is_start(shared)("key"))
        .withColumn(
            "to",
            F.explode(
                F.when(
                    F.col("begins"),
                    F.array(
                        F.struct(F.col("block").alias("block"), F.lit(0).alias("ahead")),
                        F.struct(F.pmod(F.col("block") - 1, F.lit(count)).cast("int").alias("block"), F.lit(1).alias("ahead")),
                    ),
                ).otherwise(F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("ahead"))))
            ),
        )
        .select("doc_id", "text", "key", "to.block", "to.ahead", F.xxhash64("text").alias("digest"))
        .repartition(count, "block")
        .sortWithinPartitions("block", "ahead", F.desc("key"), "digest")
        .select("doc_id", "text", "block", "ahead")
    )

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, current, closed = 0, None, False

        def flush(following: str | None) -> pa.RecordBatch:
            """Results of the waiting rows; ``following`` is the text after the last one."""

            after = [*texts[1:], following]
            edited = []
            for text, other in zip(texts, after, strict=True):
                half = len(text) // 2
                edited.append(text[: len(text) - half] + other[:half])
            chains = fingerprints(pa.array([*texts, *edited, following], pa.large_string()), ranks)
            n = len(texts)
            own, changed = chains[:n], chains[n : 2 * n]
            following_chain = [*own[1:], chains[2 * n]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, kept),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                    pa.array([encode(c) for c in own], pa.string()),
                    pa.array([encode(c) for c in changed], pa.string()),
                    pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()),
                    pa.array([likeness(a, b) for a, b in zip(own, following_chain, strict=True)], pa.float64()),
                ],
                names,
            )

        for batch in batches:
            kept = batch.schema.field("doc_id").type
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "block", "ahead"))
            for doc, text, block, ahead in zip(*columns, strict=True):
                if block != current:
                    current, closed = block, False
                if ahead:
                    if not closed and texts:
                        yield flush(text)
                        ids, texts, size = [], [], 0
                    closed = True
                    continue
                if texts and size + len(text) > SLICE_BYTES:
                    yield flush(text)
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(text)
                size += len(text)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return placed.mapInArrow(compute, f"doc_id {kind}, {RESULT}")


def _is_start(shared: Broadcast):
    @F.pandas_udf("boolean")
    def begins(key: pd.Series) -> pd.Series:
        at = np.minimum(np.searchsorted(shared.value, key.to_numpy()), len(shared.value) - 1)
        return pd.Series(shared.value[at] == key.to_numpy())

    return begins
