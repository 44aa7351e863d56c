"""Global prefix sums by DataFrame operations, without ever sorting all rows in one task."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.stage import staged


def prefix_sums(
    rows: DataFrame, order: list[str], size: str, name: str, group: str | None = None
) -> DataFrame:
    """Add ``before`` (sizes) and ``place`` (rows) of all rows earlier in ``order``, per ``group``.

    Narrow ``rows`` are range-partitioned by group and order and written once with the number of
    their partition, since a range partitioning computed twice need not be the same.  One total
    per partition and group is prefix-summed; within a partition a window continues from it.
    A group of any share of the rows spreads over as many partitions as it fills.  Rows equal
    in all of ``order`` may change places among themselves.
    """

    by = [group] if group else []
    sort = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    table = staged(
        rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("part", F.spark_partition_id()), name
    )
    totals = table.groupBy("part", *by).agg(F.sum(size).alias("part_size"), F.count("*").alias("part_rows"))
    earlier = (W.partitionBy(*by) if by else W.partitionBy()).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "part",
        *[F.col(c).alias("of_" + c) for c in by],
        F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("size_start"),
        F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("row_start"),
    )
    inside = W.partitionBy("part", *by).orderBy(*sort[len(by) :])
    running = table.withColumn(
        "here", F.coalesce(F.sum(size).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("nth", F.row_number().over(inside) - 1)
    condition = F.col("part") == F.col("part_of")
    for c in by:
        condition &= F.col(c).eqNullSafe(F.col("of_" + c))
    # one row per partition and group: its size follows the partitions, not the rows
    return running.join(starts.withColumnRenamed("part", "part_of"), condition, "left").select(
        *rows.columns,
        (F.col("size_start") + F.col("here")).alias("before"),
        (F.col("row_start") + F.col("nth")).alias("place"),
    )
