"""Order-dependent operators over tables without a usable partition key.

Row order inside a sheet (or a whole dataset) is sequential, but one task per sheet
would not scale: a sheet can hold most of the corpus.  Order is therefore cut into
fixed blocks.  Each block is scanned on its own and written with what its rows know, one
summary row per block is scanned to find what each block inherits from its predecessors, and
the summary is joined back on the block.  The sequential part sees rows / BLOCK rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from spanloom.operators.materialize import materialize

BLOCK = 1_000_000


def contiguous_groups(
    rows: DataFrame, key: str, order: str, value: str, block: int = BLOCK
) -> DataFrame:
    """Number runs of equal ``value`` in ``order`` within ``key``.

    Adds ``run_start`` (the ``order`` of the run's first row) and ``run_no`` (from 1).
    A value that returns later starts a new run.
    """

    scan = W.partitionBy(key, "block").orderBy(order)
    upto = scan.rowsBetween(W.unboundedPreceding, W.currentRow)
    # the only pass over the source: all that a row knows within its block is written beside it
    before = F.lag(value).over(scan)
    marked = rows.withColumn("block", F.floor(F.col(order) / block)).withColumn("changed", F.coalesce(before != F.col(value), F.lit(False)))
    marked = materialize(
        marked.withColumns(
            {
                "changes_here": F.count_if("changed").over(upto),
                "start_here": F.max(F.when(F.col("changed"), F.col(order))).over(upto),
            }
        ).drop("changed")
    )
    summary = marked.groupBy(key, "block").agg(
        F.min_by(value, order).alias("first"),
        F.max_by(value, order).alias("last"),
        F.min(order).alias("first_row"),
        F.max("start_here").alias("last_change"),
        F.max("changes_here").alias("changes"),
    )
    chain = W.partitionBy(key).orderBy("block")
    earlier = chain.rowsBetween(W.unboundedPreceding, -1)
    opened = summary.withColumn("opens", ~F.lag("last").over(chain).eqNullSafe(F.col("first")))
    inherited = opened.withColumn(
        "latest", F.coalesce("last_change", F.when(F.col("opens"), F.col("first_row")))
    ).select(
        key,
        "block",
        # the run that the first rows of the block belong to
        F.when(F.col("opens"), F.col("first_row")).otherwise(F.last("latest", ignorenulls=True).over(earlier)).alias("open_start"),
        (
            F.coalesce(F.sum(F.col("changes") + F.col("opens").cast("int")).over(earlier), F.lit(0)) + F.col("opens").cast("int")
        ).alias("open_no"),
    )
    return marked.join(inherited, [key, "block"]).select(
        *rows.columns,
        F.coalesce("start_here", "open_start").alias("run_start"),
        (F.col("open_no") + F.col("changes_here")).alias("run_no"),
    )


def _cell(order: Column, kind: T.DataType, block: int) -> Column:
    """What part of the data an order value lies in: cells follow each other in the order."""

    if not isinstance(kind, T.StructType):
        return F.floor(order / block)
    if "file" in kind.names:
        return F.struct(order["file"], order["block"])
    return F.struct(order["part"], _cell(order["ord"], kind["ord"].dataType, block).alias("cell"))


def number_rows(rows: DataFrame, order: str, name: str, block: int = BLOCK) -> DataFrame:
    """Consecutive numbers from 1 in ``order`` over the whole dataset, as ``name``.

    A numeric ``order`` is cut into blocks of ``block``; the struct that file readers give
    already names the split of its file, also behind the part number of a merge.
    """

    cell = _cell(F.col(order), rows.schema[order].dataType, block)
    blocked = rows.withColumn("block", cell)
    sizes = blocked.groupBy("block").agg(F.count("*").alias("rows_here"))
    # one summary row per block, so the unpartitioned window below is short
    offsets = sizes.select(
        "block",
        F.coalesce(
            F.sum("rows_here").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("offset"),
    )
    within = F.row_number().over(W.partitionBy("block").orderBy(order))
    return (
        blocked.withColumn("within", within)
        .join(offsets, "block")
        .withColumn(name, F.col("offset") + F.col("within"))
        .drop("block", "within", "offset")
    )
