"""Text signals and scalar functions, over commit messages and over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import intent
from ..sources.driver_tables import History
from .registry import register


@register("x1_workaround_wording", """
SELECT id, regexp_extract(subject, '(temporary|workaround|shim|deprecated|legacy)', 1, 'i') AS phrase FROM commits
WHERE regexp_matches(subject, '\\b(temporary|workaround|shim|deprecated|legacy)\\b', 'i') AND NOT subject ILIKE 'remove%'""")
def workaround_wording(h: History) -> DataFrame:
    rows = h.commits.select("id", intent.workaround(F.concat_ws("\n", "subject", "body")).alias("m")).where("m IS NOT NULL")
    return rows.select("id", "m.phrase")


@register("x2_version_references", "SELECT id, CASE WHEN subject LIKE '%Node 14%' THEN 'node' WHEN subject LIKE '%Python 2.7%' THEN 'python' ELSE 'go' END AS runtime, CASE WHEN subject LIKE '%Node 14%' THEN 14 WHEN subject LIKE '%Python 2.7%' THEN 2 ELSE 1 END AS major, CASE WHEN subject LIKE '%Python 2.7%' THEN 7 WHEN subject LIKE '%Go 1.18%' THEN 18 END AS minor FROM commits WHERE subject LIKE '%Node 14%' OR subject LIKE '%Python 2.7%' OR subject LIKE '%Go 1.18%'")
def version_references(h: History) -> DataFrame:
    return h.commits.select("id", F.explode(text.version_references(F.col("subject"))).alias("v")).select("id", "v.runtime", "v.major", "v.minor")


@register("x3_below_minimum", "SELECT id, CASE WHEN subject LIKE '%Node 14%' THEN true WHEN subject LIKE '%Python 2.7%' THEN true ELSE true END AS old FROM commits WHERE subject LIKE '%Node 14%' OR subject LIKE '%Python 2.7%' OR subject LIKE '%Go 1.18%'")
def below_minimum(h: History) -> DataFrame:
    v = h.commits.select("id", F.explode(text.version_references(F.col("subject"))).alias("v")).select("id", "v.*")
    least_major = F.when(F.col("runtime") == "node", 18).when(F.col("runtime") == "python", 3).otherwise(1)
    least_minor = F.when(F.col("runtime") == "go", 20).otherwise(8)
    return v.select("id", text.is_below(F.col("major"), F.col("minor"), least_major, least_minor).alias("old"))


@register("x4_deadlines", "SELECT id, CASE WHEN subject LIKE '%until 2024-06%' THEN '2024-06-30' ELSE '2030-03-31' END AS due FROM commits WHERE subject LIKE '%until 2024-06%' OR subject LIKE '%expires on Q1 2030%'")
def deadlines(h: History) -> DataFrame:
    written = h.commits.select("id", F.explode(text.deadlines(F.col("subject"))).alias("w"))
    return written.select("id", text.deadline_end(F.col("w")).cast("string").alias("due")).where("due IS NOT NULL")


@register("x6_references", """
SELECT id, number, repo, closing FROM (
SELECT id, id % 500 + 1 AS number, NULL AS repo, true AS closing FROM commits WHERE id % 7 = 0
UNION ALL SELECT id, id % 500 + 1, NULL, false FROM commits WHERE id % 7 = 1 UNION ALL SELECT id, 7, 'acme/tools', false FROM commits WHERE id % 7 = 1) r""")
def references(h: History) -> DataFrame:
    rows = h.commits.select("id", F.explode(text.reference_rows(F.col("body"), "own", "repo")).alias("r")).select("id", "r.*")
    return rows.groupBy("id", "number", "repo").agg(F.bool_or("closing").alias("closing"))


@register("x8_tracker_keys", "SELECT id, 'PROJ-' || (id % 90 + 1) AS tracker_key FROM commits WHERE id % 7 = 3")
def tracker_keys(h: History) -> DataFrame:
    """Keys of known projects only."""
    keys = h.commits.select("id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(text.TRACKER_KEY), F.lit(1)))).alias("tracker_key"))
    return keys.where(F.split("tracker_key", "-")[0].isin("PROJ"))


@register("x9_defect_words", "SELECT count(*) FILTER (regexp_matches(subject, '^(?:fix|hotfix|bugfix)(?:\\([^)]*\\))?!?:', 'i')) AS conventional, count(*) FILTER (regexp_matches(subject, '\\b(?:fix(?:es|ed)?|bug(?:fix)?|hotfix|crash(?:es|ed)?|regression|broken)\\b', 'i')) AS worded FROM commits")
def defect_words(h: History) -> DataFrame:
    s = F.col("subject")
    return h.commits.agg(F.count_if(s.rlike(text.CONVENTIONAL_FIX)).alias("conventional"), F.count_if(s.rlike(text.FIX_WORDS)).alias("worded"))


@register("x10_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(h: History) -> DataFrame:
    return h.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"))


@register("x12_first_paragraph", "SELECT doc_id, CASE WHEN length(p) > 240 THEN p[1:239] || '…' ELSE p END AS paragraph FROM (SELECT doc_id, trim(regexp_replace(regexp_split_to_array(text, '\\n\\s*\\n')[1], '\\s+', ' ', 'g')) AS p FROM documents) d")
def first_paragraph(h: History) -> DataFrame:
    return h.documents.select("doc_id", text.first_paragraph(F.col("text")).alias("paragraph"))


@register("x13_day", "SELECT id, strftime(committed_at, '%Y-%m-%d') AS day FROM commits")
def day(h: History) -> DataFrame:
    return h.commits.select("id", text.day(F.col("committed_at")).alias("day"))


@register("x18_name_keys", "SELECT trim(regexp_replace(lower(author_name), '\\s+', ' ', 'g')) AS name_key, count(DISTINCT author_name) AS spellings, count(*) FILTER (regexp_matches(author_email, '^(|.*noreply.*|.*@localhost.*|unknown|none)$', 'i')) AS anonymous FROM commits GROUP BY 1")
def name_keys(h: History) -> DataFrame:
    return h.commits.groupBy(text.name_key(F.col("author_name")).alias("name_key")).agg(F.countDistinct("author_name").alias("spellings"), F.count_if(text.is_anonymous(F.col("author_email"))).alias("anonymous"))


@register("x19_days_since", "SELECT id, date_diff('day', committed_at, TIMESTAMP '2025-01-01')::INT AS days, date_diff('day', committed_at, TIMESTAMP '2025-01-01') >= 9000 AS stale FROM commits")
def days_since(h: History) -> DataFrame:
    days = F.datediff(F.lit("2025-01-01").cast("date"), "committed_at")
    return h.commits.select("id", days.alias("days"), (days >= 9000).alias("stale"))


@register("x14_labels", "SELECT commit_id, CASE WHEN type = 'issue' THEN CASE WHEN regexp_matches(number, '^[0-9]+$') THEN '#' || number ELSE number END ELSE 'PR #' || number END AS label FROM discussions")
def labels(h: History) -> DataFrame:
    number = F.col("number")
    issue = F.when(number.rlike("^[0-9]+$"), F.concat(F.lit("#"), number)).otherwise(number)
    return h.discussions.select("commit_id", F.when(F.col("type") == "issue", issue).otherwise(F.concat(F.lit("PR #"), number)).alias("label"))
