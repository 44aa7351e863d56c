"""Digests that identify input files and tables."""

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WHOLE_BYTES = 1 << 28  # a longer file is not read as one value
CHUNK_BYTES = 8 << 20
DIGESTS = "path string, length bigint, sha256 string"


class FileDigestReader(DataSourceReader):
    """One partition per file, whose bytes pass through the digest a chunk at a time."""

    def __init__(self, options: dict):
        self.files = [options[f"file{i}"] for i in range(int(options["files"]))]
        self.chunk = int(options["chunk"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(file) for file in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system, path = fs.LocalFileSystem(), _plain(partition.value)
        if not path.startswith("/"):
            system, path = fs.FileSystem.from_uri(path)
        digest, length = hashlib.sha256(), 0
        with system.open_input_stream(path) as stream:
            while data := stream.read(self.chunk):
                digest.update(data)
                length += len(data)
        yield partition.value, length, digest.hexdigest()


class FileDigests(DataSource):
    """``path, length, sha256`` of the files ``file0`` to ``file<n-1>``."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return DIGESTS

    def reader(self, schema: object) -> DataSourceReader:
        return FileDigestReader(dict(self.options))


def _plain(name: str) -> str:
    """A file name without the scheme of local files."""

    return re.sub(r"^file:/+", "/", name)


def file_digests(spark: SparkSession, paths: list[str], whole: int = WHOLE_BYTES, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``(path, length, sha256)`` per existing input file; absent paths are skipped.

    Files of up to ``whole`` bytes are read as values; longer ones, of any size, are streamed
    by one task each in chunks of ``chunk`` bytes (local files, and the file systems that Arrow opens).
    """

    found = []
    for path in paths:
        try:
            file = spark.read.format("binaryFile").load(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found.append(file.filter(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256")))
        # names and lengths only: the content is not read for them; empty files are listed but give no row
        rows = file.select("path", (F.col("length") > whole).alias("long")).collect()
        long = [r["path"] for r in rows if r["long"]]
        seen = {_plain(r["path"]) for r in rows}
        empty = [(name, 0, hashlib.sha256().hexdigest()) for name in map(unquote, file.inputFiles()) if _plain(name) not in seen]
        if empty:
            found.append(spark.createDataFrame(empty, DIGESTS))
        if long:
            spark.dataSource.register(FileDigests)
            options = {"files": str(len(long)), "chunk": str(chunk), **{f"file{i}": name for i, name in enumerate(long)}}
            found.append(spark.read.format("file_digests").options(**options).load())
    return reduce(DataFrame.union, found, spark.createDataFrame([], DIGESTS))


def table_fingerprint(table: DataFrame, name: str) -> DataFrame:
    """``(dataset, rows, digest)``: an order-free sum of row digests, of any size.

    A row is its values, each led by its length, with a mark for NULL, so that neither an
    empty value nor one that contains a separator can pass for another row.  48 bits of each row's SHA-256 are added as DECIMAL, so rows may arrive in any order
    and the sum is combined on the map side.
    """

    value = lambda v: F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("N"))
    row = F.concat(*[value(F.col(c).cast("string")) for c in table.columns])
    number = F.conv(F.substring(F.sha2(row, 256), 1, 12), 16, 10).cast("decimal(18,0)")
    return table.agg(
        F.lit(name).alias("dataset"),
        F.count("*").alias("rows"),
        F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest"),
    )
