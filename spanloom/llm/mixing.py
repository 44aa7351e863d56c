"""Mixing sources to target weights by Pfair scheduling.

Each source is a task with its target weight as its share of the slots, each block of a source
a unit job: block ``j`` of weight ``w`` is released at slot ``floor(j / w)`` and is due at
``ceil((j + 1) / w)``.  Earliest deadline first among the released blocks keeps every
source less than one block from its share at every slot.
"""

import heapq
import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.prefix import prefix_sums
from spanloom.llm.stage import staged, staged_path

WINDOW = 256_000  # slots held by the driver at a time
MAX_SLOTS = 1 << 20  # about how many blocks the sources are cut into
MAX_SOURCES = 10_000
EPOCHS = 16  # turns of a document that meet it in one place


def smoothed_weights(sizes: dict, exponent: float) -> dict:
    """Target weights that flatten the sources' own shares: size to the power ``exponent``."""

    return {k: float(v) ** exponent for k, v in sizes.items() if v > 0}


def whole_weights(weights: Sequence[float]) -> list[int]:
    """Whole numbers in exactly the ratio of ``weights``, which are not rounded."""

    exact = [Fraction(w) for w in weights]
    if min(exact) <= 0:
        raise ValueError("weights must be positive")
    common = math.lcm(*[x.denominator for x in exact])
    return [int(x * common) for x in exact]


def pfair(weights: Sequence[int]) -> Iterator[tuple[int, int, int, int]]:
    """Slot by slot and without end ``source, job, release, deadline``, in whole-number arithmetic.

    Of the released jobs the one due first is picked.  The state is one job per source, so a
    slot costs the logarithm of the number of sources.
    """

    total = sum(weights)
    waiting = [(0, -(-total // w), i, 0) for i, w in enumerate(weights)]  # by release
    ready: list[tuple[int, int, int, int]] = []  # by deadline
    heapq.heapify(waiting)
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            release, due, i, job = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i, job, release))
        due, i, job, release = heapq.heappop(ready)
        yield i, job, release, due
        job += 1
        heapq.heappush(waiting, (job * total // weights[i], -(-(job + 1) * total // weights[i]), i, job))
        slot += 1


def block_size(sources: list[tuple[float, int]], least: int, max_slots: int) -> int:
    """Bytes of a block such that reading every source (weight, bytes) once takes about ``max_slots`` slots.

    The source that needs the longest, bytes over weight, ends the mixture.
    """

    total = sum(w for w, _ in sources)
    longest = max(size * total / w for w, size in sources if w > 0) if all(w > 0 for w, _ in sources) else 0
    return max(least, math.ceil(longest / max_slots))


def block_turns(spark: SparkSession, weights: dict, counts: dict, window: int) -> tuple[DataFrame, dict]:
    """``mix_source, mix_block, mix_epoch, mix_slot, mix_release, mix_deadline`` of every slot until
    each source has had its ``counts`` blocks once, and the last epoch of each source.

    The driver holds one ``window`` of slots at a time, which is written before the next begins; what is
    carried over is one row per source.
    """

    names = sorted(counts, key=lambda k: (k is None, k))
    last = [counts[k] - 1 for k in names]
    picks = pfair(whole_weights([weights[k] for k in names]))
    unread, start, folder, epochs = len(names), 0, None, dict.fromkeys(names, 0)
    while unread:
        source, block, epoch, release, deadline = [], [], [], [], []
        while unread and len(source) < window:
            i, job, r, d = next(picks)
            unread -= job == last[i]
            source.append(names[i])
            epoch.append(job // (last[i] + 1))
            epochs[names[i]] = epoch[-1]
            block.append(job % (last[i] + 1))
            release.append(r)
            deadline.append(d)
        columns = {
            "mix_source": pa.array(source, pa.string()),
            "mix_block": pa.array(block, pa.int64()),
            "mix_epoch": pa.array(epoch, pa.int64()),
            "mix_slot": pa.array(range(start, start + len(source)), pa.int64()),
            "mix_release": pa.array(release, pa.int64()),
            "mix_deadline": pa.array(deadline, pa.int64()),
        }
        start += len(source)
        part = spark.createDataFrame(pa.table(columns))
        if folder is None:
            folder = staged_path(spark, "mix-turns")
        part.write.mode("append").parquet(folder)
    return spark.read.schema(part.schema).parquet(folder), epochs


def mix_sources(
    docs: DataFrame,
    weights: dict | None = None,
    exponent: float = 0.9,
    block_bytes: int = 1 << 16,
    max_slots: int = MAX_SLOTS,
    seed: int = 0,
) -> DataFrame:
    """The mixture: ``docs`` rows with ``mix_block, mix_epoch, mix_slot, mix_release, mix_deadline``.

    ``docs`` has ``doc_id, text, source``.  The documents of a source are shuffled by digest and
    cut into blocks of about ``block_bytes`` of text; a document lies in the block in which its
    first byte falls.  Blocks take slots by ``weights`` (default: the sources' bytes to the power
    ``exponent``), not rounded, over the whole mixture.  The schedule is one number after another and is made
    on the driver, so the number of slots is bounded: blocks grow beyond ``block_bytes`` where the mixture would
    need more than about ``max_slots`` of them (100 TB in blocks of about 100 MB).  The deviation stays below one block, in bytes
    it grows with the block.  The mixture ends when every source has been read
    through once; a source that is due again before that starts over (``mix_epoch``), so
    that no row is dropped and every prefix keeps the weights.  A null source is a source of its own;
    sources missing in ``weights`` are an error.  Rows equal in identifier, source and text share
    their block.  An empty table gives an empty mixture.
    """

    spark = docs.sparkSession
    own = ["mix_block", "mix_epoch", "mix_slot", "mix_release", "mix_deadline"]
    rows = docs.select(*[c for c in docs.columns if c not in own])
    narrow = (
        rows.select(
            F.col("source").cast("string").alias("mix_source"),
            F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("draw"),
            "doc_id",
            F.xxhash64("text").alias("digest"),
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        )
        .groupBy("mix_source", "draw", "doc_id", "digest")
        .agg(F.sum("size").alias("size"))
    )
    placed = staged(
        prefix_sums(narrow, ["draw", "doc_id", "digest"], "size", "mix-sizes", "mix_source").select("mix_source", "doc_id", "digest", "size", "before"),
        "mix-places",
    )
    found = placed.groupBy("mix_source").agg(F.sum("size").alias("size"), F.max("before").alias("last")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not found:
        return rows.select("*", *[F.lit(None).cast("long").alias(c) for c in own]).limit(0)
    weights = smoothed_weights({r.mix_source: r["size"] for r in found}, exponent) if weights is None else weights
    missing = {r.mix_source for r in found} - set(weights)
    if missing:
        raise ValueError(f"no weight for {sorted(map(str, missing))}")
    most = block_size([(weights[r.mix_source], r["size"]) for r in found], block_bytes, max_slots)
    block = F.floor(F.col("before") / F.lit(most)).cast("long")
    turns, epochs = block_turns(spark, weights, {r.mix_source: r["last"] // most + 1 for r in found}, WINDOW)
    # a small source that comes round often meets its turns in groups of EPOCHS, each group a key of its own; at most
    # MAX_SOURCES rows
    groups = F.broadcast(
        spark.createDataFrame([(k, n // EPOCHS) for k, n in epochs.items()], "mix__g_source string, most long").select("mix__g_source", F.explode(F.sequence(F.lit(0), "most")).alias("mix__group"))
        if max(epochs.values()) >= EPOCHS
        else spark.createDataFrame([(k, 0) for k in epochs], "mix__g_source string, mix__group long")
    )
    keyed = turns.select("*", F.floor(F.col("mix_epoch") / EPOCHS).alias("mix__k_group")).withColumnsRenamed({"mix_source": "mix__k_source", "mix_block": "mix__k_block"})
    decided = (
        placed.withColumn("mix_block", block)
        .join(groups, F.col("mix_source").eqNullSafe(F.col("mix__g_source")))
        .join(keyed, F.col("mix_source").eqNullSafe(F.col("mix__k_source")) & (F.col("mix_block") == F.col("mix__k_block")) & (F.col("mix__group") == F.col("mix__k_group")))
        .select("mix__k_source", F.col("doc_id").alias("mix__k_doc"), F.col("digest").alias("mix__k_digest"), "mix__k_group", *own)
    )
    spread = rows.join(groups, F.col("source").cast("string").eqNullSafe(F.col("mix__g_source")))
    match = (
        F.col("doc_id").eqNullSafe(F.col("mix__k_doc"))
        & F.col("source").cast("string").eqNullSafe(F.col("mix__k_source"))
        & (F.xxhash64("text") == F.col("mix__k_digest"))
        & (F.col("mix__group") == F.col("mix__k_group"))
    )
    return spread.join(decided, match).select(*[spread[c] for c in rows.columns], *own)
