"""What each symbol looks like now, kept as keyed state of a stream.

Parsed versions may come in any order, in any batches and more than once. The state of a symbol in a
file is the set of its versions, a streaming aggregate; a batch reads and writes only the symbols
that it touches. Every batch writes the present row of those symbols under its own number, so a
batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "file_id long, symbol_id long, first_commit long, last_commit long, content_hash string, versions long, changes long"


def merged(known: tuple | None, rows: list[tuple]) -> tuple[list, list, list]:
    """Times, commits and hashes of a symbol's versions, by time and commit; of two hashes of one commit the greater counts.

    ``present_rows`` states the same rule in columns.
    """
    versions = {c: (t, h) for t, c, h in zip(*known)} if known else {}
    for t, c, h in rows:
        if c not in versions or (t, h) > versions[c]:
            versions[c] = (t, h)
    ordered = sorted((t, c, h) for c, (t, h) in versions.items())
    return [v[0] for v in ordered], [v[1] for v in ordered], [v[2] for v in ordered]


def present_rows(symbols: DataFrame) -> DataFrame:
    """Rows of STATE from file_id, symbol_id and ``found``, the distinct versions (commit_id, at, content_hash)."""
    last_of_commit = F.filter("found", lambda v, i: (i + 1 == F.size("found")) | (F.get("found", i + 1)["commit_id"] != v["commit_id"]))
    by_time = F.array_sort(F.transform("once", lambda v: F.struct(v["at"], v["commit_id"], v["content_hash"])))
    changed = F.filter("ordered", lambda v, i: (i > 0) & (F.get("ordered", i - 1)["content_hash"] != v["content_hash"]))
    rows = symbols.withColumn("found", F.array_sort("found")).withColumn("once", last_of_commit).withColumn("ordered", by_time)
    first, last = F.element_at("ordered", 1), F.element_at("ordered", -1)
    return rows.select("file_id", "symbol_id", first["commit_id"].alias("first_commit"), last["commit_id"].alias("last_commit"), last["content_hash"].alias("content_hash"), F.size("ordered").cast("long").alias("versions"), (F.size(changed) + 1).cast("long").alias("changes"))


def track_symbols(versions: DataFrame, path: str) -> DataFrame:
    """Present rows (columns of STATE) after taking the stream ``versions`` to its present end.

    ``versions`` (file_id, symbol_id, commit_id, committed_at, content_hash) is a streaming
    DataFrame; progress, state and results lie under ``path``, so a later call goes on from
    there. Rows without a file, symbol, commit, date or hash are passed over. The result doesn't
    depend on batches, order or repeats. ``changes`` counts versions that differ from the one before.
    """
    spark = versions.sparkSession
    clean = versions.select("file_id", "symbol_id", "commit_id", F.unix_micros(F.col("committed_at").cast("timestamp")).alias("at"), "content_hash").dropna()
    states = clean.groupBy("file_id", "symbol_id").agg(F.collect_set(F.struct("commit_id", "at", "content_hash")).alias("found"))

    def write(batch: DataFrame, number: int) -> None:
        present_rows(batch).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    run(spark, lambda: states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start())
    return present(spark, f"{path}/rows")


def present(spark: SparkSession, path: str) -> DataFrame:
    """The last row written for each symbol of a file."""
    rows = spark.read.schema(STATE + ", batch long").parquet(path)
    names = [c.split(" ")[0] for c in STATE.split(", ")]
    return rows.groupBy("file_id", "symbol_id").agg(F.max_by(F.struct(*names[2:]), "batch").alias("now")).select("file_id", "symbol_id", "now.*")


def run(spark: SparkSession, start) -> None:
    """Starts a stream on the state store that keyed state needs and waits for it; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    query.awaitTermination()
