"""Sinks: JSON Lines datasets and JSON reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(records: DataFrame) -> DataFrame:
    """Compact JSON per record, non-ASCII kept, fields in table order, ``ord`` left out.

    The fields of an ``extra`` object, as the reader keeps them, follow the others.
    """

    fields = [c for c in records.columns if c not in ("ord", "extra")]
    line = F.to_json(F.struct(*fields))
    if "extra" in records.columns:
        both = F.concat(F.substr(line, F.lit(1), F.length(line) - 1), F.lit(","), F.substr(F.col("extra"), F.lit(2)))
        line = F.when(F.col("extra").isNull(), line).otherwise(both)
    return records.select(line.alias("value"))


def write_jsonl(
    records: DataFrame, path: str, *, overwrite: bool = False, ordered: bool = False
) -> None:
    """Write a dataset as a folder of JSON Lines files, the partitions as they are.

    ``ordered`` sorts by ``ord`` across the files (range partitioning, so no single task
    holds the dataset).
    """

    rows = records.orderBy("ord") if ordered else records
    json_lines(rows).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_report(report: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Write metric or manifest rows (a few dozen) as one JSON Lines file."""

    report.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").json(path)
