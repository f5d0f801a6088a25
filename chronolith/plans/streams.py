"""Ingestion as streams: what is known is skipped, symbols are tracked in keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import linking
from ..sources.driver_tables import History
from ..streaming import ingest, symbol_state, work_queue
from .registry import register


@register("t1_ingest_new", "SELECT o_orderkey AS id, md5(o_orderkey::VARCHAR) AS sha FROM orders")
def ingest_new(h: History) -> DataFrame:
    """Commits taken from a stream that brings each of them twice: what is known is skipped."""
    source, path = f"{h.sf_dir}/orders.parquet", ingest.stream_path(h.spark, "commits")
    log = lambda: ingest.stream_of(h.spark, source).select(F.col("o_orderkey").alias("id"), F.md5(F.col("o_orderkey").cast("string")).alias("sha"))
    ingest.ingest_new(log().unionAll(log()), f"{path}/rows", f"{path}/progress", "sha")
    return h.spark.read.parquet(f"{path}/rows").select("id", "sha")


@register("t5_symbol_state", """
SELECT file_id, symbol_id, arg_min(commit_id, n) AS first_commit, arg_max(commit_id, n) AS last_commit, arg_max(content_hash, n) AS content_hash, count(*) AS versions, count(*) FILTER (WHERE before IS NULL OR before <> content_hash) AS changes
FROM (SELECT *, row_number() OVER w AS n, lag(content_hash) OVER w AS before FROM (
  SELECT l_partkey AS file_id, l_partkey * 100000 + l_suppkey AS symbol_id, l_orderkey AS commit_id, any_value(o_orderdate) AS day, max(md5(l_suppkey % 40 || '/' || l_quantity::BIGINT % 7)) AS content_hash
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) v WINDOW w AS (PARTITION BY file_id, symbol_id ORDER BY day, commit_id)) o GROUP BY file_id, symbol_id""")
def symbol_states(h: History) -> DataFrame:
    """Line items as parsed versions, in the order of their file, not of the commits' dates."""
    commits = h.orders.select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("committed_at"))
    lines = ingest.stream_of(h.spark, f"{h.sf_dir}/lineitem.parquet")
    text = F.concat_ws("/", (F.col("l_suppkey") % 40).cast("string"), (F.col("l_quantity").cast("long") % 7).cast("string"))
    versions = lines.select(F.col("l_partkey").alias("file_id"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("symbol_id"), F.col("l_orderkey").alias("commit_id"), F.md5(text).alias("content_hash"))
    return symbol_state.track_symbols(versions.join(commits, "commit_id"), ingest.stream_path(h.spark, "symbols"))


#: Changes of a batch, at least, unless fewer are left.
BATCH = 10_000
#: Batches that are written by one job.
TOGETHER = 256


@register("t4_work_batches", "SELECT k AS batch, count(*) AS commits, sum(n)::BIGINT AS changes, arg_min(commit_id, cum) AS first_commit, arg_max(commit_id, cum) AS last_commit FROM cums JOIN ends ON cum > start AND cum <= stop GROUP BY k", f"""
cums AS MATERIALIZED (SELECT commit_id, n, sum(n) OVER (ORDER BY committed_at, commit_id) AS cum FROM (SELECT commit_id, committed_at, count(*) AS n FROM dated_changes WHERE status IN ('added', 'modified') AND additions IS NOT NULL GROUP BY 1, 2) g),
ends AS (SELECT 0 AS k, 0::HUGEINT AS start, least((SELECT min(cum) FROM cums WHERE cum >= {BATCH}), (SELECT max(cum) FROM cums)) AS stop
  UNION ALL SELECT k + 1, stop, coalesce((SELECT min(cum) FROM cums WHERE cum >= e.stop + {BATCH}), (SELECT max(cum) FROM cums)) FROM ends e WHERE stop < (SELECT max(cum) FROM cums))""", recursive=True)
def work_batches(h: History) -> DataFrame:
    """All pending changes done in batches that end with a commit, as the marks tell."""
    pending = h.dated_changes.where("status IN ('added', 'modified') AND additions IS NOT NULL").select("id", "commit_id", "committed_at").checkpoint()
    queue = work_queue.WorkQueue(h.spark, ingest.stream_path(h.spark, "queue"))
    queue.run(pending, "committed_at", "commit_id", BATCH, lambda rows: rows, together=TOGETHER)
    order = F.struct("committed_at", "commit_id")
    return queue.results().groupBy(F.col("batch").cast("int").alias("batch")).agg(F.countDistinct("commit_id").alias("commits"), F.count("*").alias("changes"), F.min_by("commit_id", order).alias("first_commit"), F.max_by("commit_id", order).alias("last_commit"))


@register("t7_negative_cache_days", """SELECT number, CASE WHEN last IS NULL THEN 'new' ELSE 'expired' END AS reason FROM (SELECT DISTINCT number FROM discussions WHERE provider = 'jira') w
LEFT JOIN (SELECT number, max(committed_at) AS last FROM discussions d JOIN commits m ON m.id = d.commit_id WHERE m.id % 3 = 0 GROUP BY number) c USING (number)
WHERE last IS NULL OR last <= (SELECT max(committed_at) FROM commits) - INTERVAL 7 DAY""")
def negative_cache(h: History) -> DataFrame:
    """Tracker keys to look up: never asked for, or asked in vain seven days ago or longer, as of the last commit."""
    named = h.discussions.where("provider = 'jira'").select("number").distinct()
    asked = h.discussions.join(h.commits.where("id % 3 = 0").select(F.col("id").alias("commit_id"), F.col("committed_at").alias("checked_at")), "commit_id").select("number", "checked_at")
    return linking.due_lookups(named, asked, h.commits.agg(F.max("committed_at").alias("now")), ["number"])
