"""Intermediate results in the shared folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below the checkpoint folder and read back, for loops that join a result with itself.

    A checkpoint keeps the optimiser's estimate of the plan it replaces. A join's estimate is the product of its
    sides', so a loop's has twice to four times as many digits after each round, until they fill the driver's
    memory. Files have a size of their own.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{folder}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Shuffle files of steps that are written out go now. They lie on disk until the driver's JVM collects what
    refers to them, which a small driver over large tables may not do before the disk is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written out as by ``written``; what it was made from leaves the disk before the next step."""
    out = written(df)
    release(df.sparkSession)
    return out
