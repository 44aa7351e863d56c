"""Tables written once and read several times, in the folder all executors share."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.materialize import checkpoint_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    Unlike a cached table it survives the loss of executors, and unlike ``checkpoint()`` it is
    compressed and keeps column pruning.  The folder may be cleared once the application ends.
    """

    spark = df.sparkSession
    path = staged_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``."""

    return f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Fewer rows to an Arrow batch while an action runs: whole texts go to Python in them."""

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fold_of(column: str, folds: int):
    """``crc32`` of the identifier written as text, modulo ``folds`` (null for a null identifier)."""

    return F.crc32(F.col(column).cast("string")) % F.lit(folds)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, seed: str) -> DataFrame:
    """``doc_id, text, label, draw`` of at most ``rows`` labelled identifiers.

    ``labels`` has ``doc_id, label``; those of smallest digest are taken, so the choice does not
    depend on the layout.  Nulls in either are left out, of several labels the largest holds.
    The sample of identifiers is small enough to broadcast, so the texts are not shuffled.
    """

    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    chosen = (
        labels.where("label is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("label").cast("int").alias("label"))
        .withColumn("draw", draw)
        .orderBy("draw", "doc_id")
        .limit(rows)
    )
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def parts(text: pa.ChunkedArray | pa.Array, limit: int):
    """Slices ``(start, stop)`` of an Arrow text column with about ``limit`` bytes each.

    A single longer text is a slice of its own, so that working arrays stay bounded by the
    longest text and not by the size of the Arrow batch.
    """

    import pyarrow.compute as pc

    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(text), 0).to_pylist()):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(text):
        yield start, len(text)
