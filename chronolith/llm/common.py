"""Shared helpers: table access, the shared scratch folder and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task handles at once; keeps Python memory flat for any row length mix.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset and all runs on one machine (tests), a fresh temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
            found = context.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back; cuts the lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate results of one operator, each written once in the shared folder; ``clear`` removes them all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.number = spark, fresh_path(spark, name), 0

    def write(self, df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
        """``group_rows``: most rows of a row group, for rows of megabytes. The writer looks at its memory every hundred
        rows only, and a reader takes up to 4096 rows of a group at once."""
        self.number += 1
        path = f"{self.path}/{self.number:03d}-{name}"
        writer = df.write.option("compression", "zstd")
        if group_rows:
            writer = writer.option("parquet.block.row.count.limit", group_rows)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession, records: int = 512) -> None:
    """Arrow batches of at most ``records`` rows, so that long texts don't pile up in one batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > records:
        spark.conf.set(key, str(records))


def chunks(values: list, weight, limit: int = CHUNK_BYTES):
    """Consecutive slices ``(from, to)`` of ``values`` with a total weight near ``limit``."""
    begin = total = 0
    for i, value in enumerate(values):
        total += weight(value)
        if total >= limit:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(values):
        yield begin, len(values)
