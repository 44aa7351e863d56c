"""Streaming intake and normalization of records arriving as files of JSON Lines."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from spanloom.operators.rows import each
from spanloom.functions.text import cleaned_surface, with_surfaces
from spanloom.sources.records import parse_records


def read_stream(
    spark: SparkSession, folder: str, files_per_trigger: int = 100, bytes_per_trigger: int | None = None
) -> DataFrame:
    """``(arrived, value)`` lines of the files appearing in ``folder``.

    A batch takes ``files_per_trigger`` files or, if given, files of about ``bytes_per_trigger`` bytes.

    ``arrived`` is the time of the batch that read the line, whatever the age of its file, so no
    line can be late for the watermark.
    """

    # the source would otherwise pass over files much older than the newest
    options = {"maxFileAge": "36500d"}
    if bytes_per_trigger is None:
        options["maxFilesPerTrigger"] = files_per_trigger
    else:
        options["maxBytesPerTrigger"] = bytes_per_trigger
    lines = spark.readStream.options(**options).text(folder)
    return lines.select(F.current_timestamp().alias("arrived"), "value")


def parse_stream(lines: DataFrame, require_entities: bool = False) -> DataFrame:
    """``(arrived, value, hash, text, entities, error)``; no state is kept here."""

    keyed = lines.withColumn("ord", F.col("arrived"))
    parsed = parse_records(keyed, require_entities=require_entities)
    return parsed.withColumnRenamed("ord", "arrived")


class FirstLines(StatefulProcessor):
    """Per hash a mark that a line of it was accepted, which a timer removes after ``delay``."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("accepted", "accepted boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        seen = self.mark.exists()
        for chunk in rows:
            errors = [None if not seen and i == 0 else "duplicate_hash" for i in range(len(chunk))]
            if not seen and len(chunk):
                seen = True
                at = chunk["arrived"].iloc[0]
                at = at if at.tzinfo else at.tz_localize("UTC")
                self.mark.update((True,))
                self.handle.registerTimer(max(at.value // 1_000_000, timers.getCurrentWatermarkInMs()) + self.delay_ms)
            yield chunk.assign(error=pd.Series(errors, index=chunk.index, dtype=object))

    def handleExpiredTimer(self, key: tuple, timers: object, expired: object) -> Iterator[pd.DataFrame]:
        self.mark.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_checked(parsed: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Every arriving line once, with ``error``: ``arrived, hash, value, text, entities, error``.

    ``entities`` is JSON text.  A line without an error is accepted, and each hash has one accepted line
    within ``delay``; its other lines, also those with another text, are ``duplicate_hash``.  One operator
    decides both, so that what is accepted and what is rejected add up to what arrived.  The state is one mark
    per hash that a timer on the arrival removes; it needs the RocksDB state store (``use_state_store``).
    """

    columns = ["arrived", "hash", "value", "text", "entities"]
    listed = F.to_json("entities") if "entities" in parsed.columns else F.lit(None).cast("string")
    lines = parsed.withColumn("entities", listed)
    rejected = lines.filter("error is not null").select(*columns, "error")
    decided = (
        lines.filter("error is null")
        .select(*columns)
        .withWatermark("arrived", "0 seconds")
        .groupBy("hash")
        .transformWithStateInPandas(
            FirstLines(pd.Timedelta(delay) // pd.Timedelta(milliseconds=1)),
            "arrived timestamp, hash string, value string, text string, entities string, error string",
            "Append",
            "EventTime",
        )
    )
    return rejected.unionByName(decided)


def use_state_store(spark: SparkSession) -> None:
    """Keep the state of streams in RocksDB on the executors' disks, with its changes in the checkpoint."""

    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def write_checked(checked: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start the stream into one table partitioned by ``kept``, so that both parts are committed together."""

    return (
        checked.withColumn("kept", F.col("error").isNull())
        .writeStream.format("parquet")
        .partitionBy("kept")
        .option("checkpointLocation", checkpoint)
        .option("path", folder)
        .trigger(availableNow=True)
        .start()
    )


def stream_intake(checked: DataFrame) -> DataFrame:
    """The accepted lines of ``stream_checked`` or of the table it was written to."""

    return checked.filter("error is null").select("arrived", "hash", "text", "entities")


def stream_quarantine(checked: DataFrame) -> DataFrame:
    """``(arrived, hash, value, error)`` of the rejected lines and of repeats, as ``duplicate_hash``."""

    return checked.filter("error is not null").select("arrived", "hash", "value", "error")


def stream_normalize(predictions: DataFrame, index: DataFrame) -> DataFrame:
    """Entities of arriving predictions with surface and canonical name.

    ``index`` comes from ``alias_index``.  Each batch is planned on its own: a small index is
    broadcast by Spark's own size check, a larger one joined by shuffle.
    """

    listed = with_surfaces(F.col("text"), F.col("entities"))
    rows = each(predictions, ["hash"], listed)
    named = rows.withColumn("named", cleaned_surface(F.col("surface")))
    keyed = named.withColumns({"cleaned": F.col("named.cleaned"), "alias_key": F.col("named.key")})
    usable = index.filter("error is null").select("label", "alias_key", "canonical")
    return keyed.join(usable, ["label", "alias_key"], "left").select(
        "hash", "label", "start", "end", "surface", F.coalesce("canonical", "cleaned").alias("normalized")
    )
