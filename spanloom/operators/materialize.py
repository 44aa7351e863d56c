"""Cutting lineage where a result is read several times."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a temporary one on a local session."""

    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spanloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Written once as Parquet in the shared folder and read back.

    It survives the loss of executors, is compressed, and a reader of few columns reads only those.
    The folder may be cleared when the application has ended.
    """

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
