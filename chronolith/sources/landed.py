"""Issues and pull requests from landed JSON pages, with a high-water mark for the next sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = (
    "number bigint, title string, body string, state string, user struct<login: string>, labels array<struct<name: string>>, "
    "created_at string, updated_at string, closed_at string, html_url string, pull_request struct<merged_at: string, url: string>"
)


def read_items(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Issues and pull requests of landed pages (arrays of items), each number at its latest update.

    ``since`` is the saved mark: only what was updated at or after it is taken, so a page that
    is landed twice changes nothing.
    """
    rows = spark.read.schema(ITEM).option("multiLine", True).json(path)
    if since:
        rows = rows.where(F.col("updated_at") >= since)
    latest = rows.groupBy("number").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "number"]), "updated_at").alias("i")).select("number", "i.*")
    return latest.select(
        "number", "title", F.coalesce("body", F.lit("")).alias("body"), "state", F.col("user.login").alias("author"), F.coalesce(F.col("labels.name"), F.array().cast("array<string>")).alias("labels"),
        F.to_timestamp("created_at").alias("created_at"), F.to_timestamp("updated_at").alias("updated_at"), F.to_timestamp("closed_at").alias("closed_at"),
        F.when(F.col("pull_request").isNotNull(), "pull_request").otherwise("issue").alias("type"), F.to_timestamp("pull_request.merged_at").alias("merged_at"), "html_url",
    )


def high_water_mark(items: DataFrame) -> str | None:
    """The newest update, as the next ``since``; None for an empty sync, which leaves the mark as it was."""
    found = items.agg(F.date_format(F.max("updated_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
    return found


def upsert(stored: DataFrame, fresh: DataFrame, by: list[str], stamp: str = "updated_at") -> DataFrame:
    """Stored and fresh rows, one per key: the later stamp, and the fresh row if they are equal."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    others = [c for c in stored.columns if c not in by]
    return both.groupBy(*by).agg(F.max_by(F.struct(*others), F.struct(stamp, "_new")).alias("r")).select(*by, *[f"r.{c}" for c in others])
