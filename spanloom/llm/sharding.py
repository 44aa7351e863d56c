"""Sharding: contiguous shards of nearly equal bytes from global prefix sums."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.prefix import prefix_sums
from spanloom.llm.stage import staged

OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, shards: int, overhead: int = OVERHEAD) -> DataFrame:
    """Shard of each document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus ``overhead``.  In order of
    ``doc_id`` (nulls first, then by checksum and size) the bytes before a document and half of
    its own decide: cut at equal targets, every shard is within the largest document of
    its target.  ``slot`` numbers the documents of a shard without gaps.  With few
    documents, or one very large one, shards may stay empty.  Rows that are equal in all
    three are interchangeable.  Sums are exact up to ``2**63 / (2 * shards)`` bytes.
    """

    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = prefix_sums(rows, ["doc_id", "text_crc32", "size"], "size", "shard-sizes")
    placed = staged(placed, "shard-places")  # narrow; three passes follow
    total = placed.agg(F.sum("size")).first()[0] or 1
    shard = F.expr(f"((2 * before + size) * {shards}L) div {2 * total}L").cast("int")
    placed = placed.withColumn("shard", F.least(shard, F.lit(shards - 1)))
    # places only grow with the shard number: one first place per shard
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
