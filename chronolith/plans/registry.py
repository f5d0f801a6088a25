"""Registered queries: a name, a function of the canonical tables, and the same in DuckDB SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.driver_tables import History, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Loops write checkpoints: to spark.checkpoint.dir, or to a fresh folder where it is unset and all runs on one machine (tests)."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return spark


def register(name: str, sql: str | None = None, ctes: str = "", recursive: bool = False):
    """Decorator: registers ``build(history) -> DataFrame`` as a query, with its oracle if there is one."""

    def add(build: Callable[[History], DataFrame]) -> Callable[[History], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(History(ready(spark), sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql, ctes, recursive)
        return build

    return add
