"""Incremental ingestion: what is there now, taken as a stream; state by event date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .symbol_state import run


def touch_state(changes: DataFrame) -> DataFrame:
    """(file_id, first_commit, last_commit, deleted), decided by commit order and not by arrival."""
    return changes.groupBy("file_id").agg(F.min("commit_id").alias("first_commit"), F.max("commit_id").alias("last_commit"), (F.max_by("status", "commit_id") == "deleted").alias("deleted"))


def ingest_new(rows: DataFrame, target: str, progress: str, key: str) -> None:
    """Appends the rows of a stream to ``target``, each ``key`` once, and stops at the stream's present end.

    Keys that were taken are the stream's state (under ``progress``, with what has been read), so a
    batch looks up its own keys and doesn't read ``target`` again. A batch that is run again is
    written under its own number and replaces itself. Of rows with one key any one is taken; rows
    without a key are one row.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = rows.dropDuplicates([key]).writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True)
    run(rows.sparkSession, stream.start)


def stream_of(spark: SparkSession, source: str, files: int | None = None) -> DataFrame:
    """A Parquet folder or file as a stream, ``files`` a batch at most."""
    stream = spark.readStream.schema(spark.read.parquet(source).schema)
    if files:
        stream = stream.option("maxFilesPerTrigger", files)
    return stream.parquet(_folder(spark, source))


def stream_path(spark: SparkSession, name: str) -> str:
    """A fresh place for a stream's results and progress in the shared folder."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def event_totals(spark: SparkSession, source: str) -> DataFrame:
    """Totals by event_type of a table read as a stream, each event once; order-independent aggregates, so late files don't matter."""
    path = stream_path(spark, "event-totals")

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream = stream_of(spark, source).dropDuplicates(["event_id"])
    run(spark, stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start)
    parts = spark.read.schema("event_type string, user_id bigint, n bigint, lo bigint, hi bigint").parquet(f"{path}/rows")
    return parts.groupBy("event_type").agg(F.sum("n").alias("events"), F.min("lo").alias("first_id"), F.max("hi").alias("last_id"), F.countDistinct("user_id").alias("users"))


def _folder(spark: SparkSession, source: str) -> str:
    """A pattern that the streaming file source takes for a single file (that one alone) as well as for a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    return source if status.isDirectory() else f"{source[:-1]}[{source[-1]}]"
