"""Token tables: one row per token, a sheet column instead of workbook sheets."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = ("sentence_id", "word", "tag")


def read_token_rows(spark: SparkSession, path: str, sheets: tuple[str, ...]) -> DataFrame:
    """Token rows ``(sheet, row_no, sentence_id, word, tag, error)`` from Parquet or CSV."""

    if path.endswith(".csv"):
        rows = spark.read.csv(
            path, header=True, schema="sheet string, row_no bigint, sentence_id string, word string, tag string"
        )
    else:
        rows = spark.read.parquet(path)
    return select_sheets(rows, sheets)


def select_sheets(rows: DataFrame, sheets: tuple[str, ...]) -> DataFrame:
    """Rows of the wanted sheets, cells trimmed; a missing or empty cell sets ``error``.

    A wanted sheet without any row is an error.
    """

    wanted = rows.filter(F.col("sheet").isin(*sheets))
    present = {r["sheet"] for r in wanted.select("sheet").distinct().collect()}
    missing = [s for s in sheets if s not in present]
    if missing:
        raise ValueError(f"missing sheets {missing}")
    edge = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
    trimmed = wanted.select(
        "sheet", "row_no", *[F.regexp_replace(c, edge, "").alias(c) for c in CELLS]
    )
    bad = F.coalesce(
        *[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in CELLS]
    )
    return trimmed.withColumn("error", bad)
