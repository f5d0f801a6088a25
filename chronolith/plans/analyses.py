"""Status, usage, activity, defects, hotspots, ownership, fossils, fixes and dead intent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels, paths, text
from ..operators import activity, intent, people
from ..sources.driver_tables import History
from .reads import CODE_SQL, DECLARATION_SQL, GENERATED_SQL, ILLUSTRATIVE_SQL, TEST_SQL
from .registry import register

RANKABLE_SQL = f"NOT {TEST_SQL} AND NOT {GENERATED_SQL} AND {CODE_SQL}"
ROUND3 = "floor(({}) * 1000 + 0.5) / 1000"

#: Rename lineage, level by level to its end; a file's first bound counts. ``seen`` has all files that a root has met.
LINEAGE_CTES = ",\n".join(
    [
        "renames AS (SELECT file_id, previous_file_id AS previous, committed_at AS renamed_at, id AS change_id FROM dated_changes WHERE status = 'renamed' AND previous_file_id IS NOT NULL)",
        "traced AS (SELECT id AS root, id AS file_id, NULL::TIMESTAMP AS until, [id] AS seen FROM files WHERE NOT deleted"
        " UNION ALL SELECT root, previous, renamed_at, list_concat(seen, list(previous) OVER (PARTITION BY root)) FROM (SELECT l.root, l.seen, r.previous, r.renamed_at, row_number() OVER (PARTITION BY l.root, r.previous ORDER BY r.renamed_at, r.change_id) AS n"
        " FROM traced l JOIN renames r ON l.file_id = r.file_id AND (l.until IS NULL OR r.renamed_at <= l.until) WHERE NOT list_contains(l.seen, r.previous)) x WHERE n = 1)",
        "lineage AS (SELECT root, file_id, until FROM traced)",
        "content AS (SELECT l.root, f.path, c.commit_id, c.additions, c.deletions, c.committed_at FROM lineage l JOIN dated_changes c ON l.file_id = c.file_id AND (l.until IS NULL OR c.committed_at <= l.until) JOIN files f ON f.id = l.root WHERE NOT (c.status = 'renamed' AND coalesce(c.additions, 0) + coalesce(c.deletions, 0) = 0))",
        "activity AS (SELECT root AS file_id, path, count(DISTINCT commit_id) AS commits, cast(sum(CASE WHEN additions IS NULL THEN 0 ELSE additions + coalesce(deletions, 0) END) AS bigint) AS churn, count(*) FILTER (additions IS NULL) AS binary_changes, max(committed_at) AS last_changed_at FROM content GROUP BY 1, 2)",
    ]
)
_NOT_DEFECT = text.NOT_A_DEFECT.removeprefix("(?i)").replace("'", "''")
DEFECT_CTES = f"""signals AS (
SELECT commit_id, 'labelled issue' AS reason, CASE WHEN level = 'INFERRED' THEN 'INFERRED' ELSE 'DERIVED' END AS level, confidence::DOUBLE AS confidence, 1 AS rule FROM discussions
  WHERE relation = 'RESOLVED_BY' AND type = 'issue' AND regexp_matches(label, '\\b(bug|defect|regression|crash|incident)\\b', 'i')
UNION ALL SELECT commit_id, 'bug ticket', 'INFERRED', 0.7, 2 FROM discussions
  WHERE relation = 'REFERENCES' AND type = 'issue' AND provider IN ('jira', 'linear') AND regexp_matches(label, '\\b(bug|defect|regression|crash|incident)\\b', 'i')
UNION ALL SELECT commit_id, reason, 'INFERRED', CASE reason WHEN 'revert' THEN 0.7 WHEN 'marked fix' THEN 0.6 ELSE 0.5 END, 3 FROM (
  SELECT id AS commit_id, CASE WHEN subject ILIKE 'Revert "%' OR regexp_matches(body, 'This reverts commit [0-9a-f]{{7,}}', 'i') THEN 'revert'
    WHEN regexp_matches(subject, '{_NOT_DEFECT}', 'i') THEN NULL
    WHEN regexp_matches(subject, '^(?:fix|hotfix|bugfix)(?:\\([^)]*\\))?!?:', 'i') THEN 'marked fix'
    WHEN regexp_matches(subject, '\\b(?:fix(?:es|ed)?|bug(?:fix)?|hotfix|crash(?:es|ed)?|regression|broken)\\b', 'i') THEN 'fix wording' END AS reason FROM commits) w WHERE reason IS NOT NULL),
defects AS (SELECT commit_id, reason, level, confidence FROM (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY confidence DESC, rule, reason DESC, level DESC) AS n FROM signals) s WHERE n = 1)"""


def reach_ctes(edges: str, depth: int = activity.REACH_DEPTH) -> str:
    """Pairs (root, node) within ``depth`` hops over an edge query (source, target)."""
    return f"""reach_edges AS (SELECT DISTINCT source, target FROM ({edges}) e WHERE source <> target),
walk AS (SELECT target AS root, source AS node, 1 AS depth FROM reach_edges
  UNION SELECT w.root, e.source, w.depth + 1 FROM walk w JOIN reach_edges e ON e.target = w.node WHERE w.depth < {depth} AND e.source <> w.root),
reached AS (SELECT DISTINCT root, node FROM walk)"""


@register("a1_status", """
SELECT (SELECT count(*) FROM commits) AS commits, (SELECT count(*) FROM files WHERE NOT deleted) AS files, (SELECT count(*) FROM changes) AS changes,
  (SELECT count(*) FROM symbols WHERE current) AS symbols, (SELECT count(*) FROM relations) AS relations, (SELECT max_by(id, committed_at::VARCHAR || lpad(id::VARCHAR, 12, '0')) FROM commits) AS latest_commit""")
def status(h: History) -> DataFrame:
    counts = [h.commits.agg(F.count("*").alias("commits"), F.max_by("id", F.struct("committed_at", "id")).alias("latest_commit")), h.files.agg(F.count_if(~F.col("deleted")).alias("files")), h.changes.agg(F.count("*").alias("changes")), h.symbols.agg(F.count_if("current").alias("symbols")), h.relations.agg(F.count("*").alias("relations"))]
    table = counts[0]
    for c in counts[1:]:
        table = table.crossJoin(c)  # one row each
    return table.select("commits", "files", "changes", "symbols", "relations", "latest_commit")


@register("a1_levels", "SELECT l.level, count(r.id) AS n FROM (SELECT unnest(['FACT', 'DERIVED', 'INFERRED']) AS level) l LEFT JOIN relations r ON r.level = l.level GROUP BY l.level")
def level_counts(h: History) -> DataFrame:
    """Zero-filled by level."""
    domain = h.spark.createDataFrame([(x,) for x in levels.LEVELS], "level string")
    return domain.join(h.relations.groupBy("level").agg(F.count("*").alias("n")), "level", "left").fillna(0, ["n"])


@register("a2_import_usage", "SELECT f.id, count(i.source) AS n FROM files f LEFT JOIN (SELECT DISTINCT source, target FROM imports) i ON i.target = f.id GROUP BY f.id")
def usage(h: History) -> DataFrame:
    used = h.imports.select("source", "target").distinct().groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))
    return h.files.select("id").join(used, "id", "left").fillna(0, ["n"])


@register("a3_file_activity", "SELECT file_id, path, commits, churn, binary_changes, strftime(last_changed_at, '%Y-%m-%d') AS last_day FROM activity", LINEAGE_CTES, recursive=True)
def file_activity(h: History) -> DataFrame:
    table = activity.file_activity(h.files, h.dated_changes)
    return table.select("file_id", "path", "commits", "churn", "binary_changes", F.date_format("last_changed_at", "yyyy-MM-dd").alias("last_day"))


@register("g9_rename_lineage", "SELECT root, file_id, strftime(until, '%Y-%m-%d') AS until_day FROM lineage", LINEAGE_CTES, recursive=True)
def lineage(h: History) -> DataFrame:
    return activity.rename_lineage(h.files.where("NOT deleted"), h.dated_changes).select("root", "file_id", F.date_format("until", "yyyy-MM-dd").alias("until_day"))


@register("a6_import_reach", f"SELECT r.root AS file_id, count(*) AS dependents, count(*) FILTER ({TEST_SQL}) AS tests FROM reached r LEFT JOIN files f ON f.id = r.node GROUP BY r.root", reach_ctes("SELECT source, target FROM imports"), recursive=True)
def import_reach(h: History) -> DataFrame:
    return activity.import_reach(h.imports, h.files.select("id", paths.is_test(F.col("path")).alias("is_test")))


@register("a7_defects", "SELECT commit_id, reason, level, confidence FROM defects", DEFECT_CTES)
def defects(h: History) -> DataFrame:
    return activity.classify_defects(h.commits, h.discussions)


HOTSPOT_CTES = ",\n".join([
    LINEAGE_CTES, DEFECT_CTES, reach_ctes("SELECT source, target FROM imports"),
    f"reach AS (SELECT r.root AS file_id, count(*) AS dependents, count(*) FILTER ({TEST_SQL}) AS tests FROM reached r LEFT JOIN files f ON f.id = r.node GROUP BY r.root)",
    "faults AS (SELECT root AS file_id, count(*) AS defects, max(CASE level WHEN 'INFERRED' THEN 2 WHEN 'DERIVED' THEN 1 ELSE 0 END) AS rank FROM (SELECT DISTINCT root, commit_id FROM content) c JOIN defects USING (commit_id) GROUP BY root)",
    "coverage AS (SELECT file_id, n_found AS found, n_found // step AS hit, CASE WHEN fresh THEN TIMESTAMP '2002-01-01' ELSE TIMESTAMP '1996-01-01' END AS written_at FROM line_coverage)",
    f"ranked AS (SELECT a.*, coalesce(x.defects, 0) AS defects, x.rank, coalesce(r.dependents, 0) AS dependents, coalesce(r.tests, 0) AS tests, CASE WHEN v.found > 0 AND v.written_at >= a.last_changed_at THEN v.found END AS found, CASE WHEN v.found > 0 AND v.written_at >= a.last_changed_at THEN v.hit END AS hit FROM activity a LEFT JOIN faults x USING (file_id) LEFT JOIN reach r USING (file_id) LEFT JOIN coverage v USING (file_id) WHERE {RANKABLE_SQL})",
    "tops AS (SELECT max(commits) AS c, max(churn) AS h, max(defects) AS d, max(dependents) AS n FROM ranked)",
    "scored AS (SELECT file_id, path, commits, churn, binary_changes, defects, dependents, tests, "
    + ROUND3.format("(CASE WHEN c > 0 THEN commits / c ELSE 0 END) * (CASE WHEN h > 0 THEN churn / h ELSE 0 END) * ((defects + 1) / (d + 1))") + " AS score, "
    + ROUND3.format("(CASE WHEN c > 0 THEN commits / c ELSE 0 END) * (CASE WHEN n > 0 THEN dependents / n ELSE 0 END) * (defects / commits) * (CASE WHEN found IS NOT NULL THEN 1 - hit / found ELSE 1 / (1 + tests) END)") + " AS risk, "
    + ROUND3.format("CASE WHEN found IS NOT NULL THEN 1 - hit / found ELSE 1 / (1 + tests) END") + " AS test_reach_inverse, CASE WHEN rank = 2 THEN 'INFERRED' ELSE 'DERIVED' END AS level FROM ranked CROSS JOIN tops)",
])


def _hotspots(h: History) -> DataFrame:
    written = F.when(F.col("fresh"), F.lit("2002-01-01")).otherwise(F.lit("1996-01-01")).cast("timestamp_ntz")
    coverage = h.line_coverage.select("file_id", F.col("n_found").alias("found"), F.floor(F.col("n_found") / F.col("step")).alias("hit"), written.alias("written_at"))
    return activity.hotspots(h.files, h.dated_changes, h.commits, h.discussions, h.imports, coverage).drop("last_changed_at")


@register("a4_hotspots", "SELECT * FROM scored ORDER BY score DESC, commits DESC, path LIMIT 25", HOTSPOT_CTES, recursive=True)
def hotspots(h: History) -> DataFrame:
    return activity.top_hotspots(_hotspots(h))


@register("a5_risk", "SELECT file_id, path, risk, test_reach_inverse FROM scored", HOTSPOT_CTES, recursive=True)
def risk(h: History) -> DataFrame:
    return _hotspots(h).select("file_id", "path", "risk", "test_reach_inverse")


#: Smallest name of each component: labels spread over addresses for a fixed number of rounds.
PEOPLE_CTES = ",\n".join([
    "authored AS (SELECT id, author_name, committed_at, trim(regexp_replace(lower(author_name), '\\s+', ' ', 'g')) AS name_key, CASE WHEN NOT regexp_matches(trim(author_email), '^(|.*noreply.*|.*@localhost.*|unknown|none)$', 'i') THEN lower(trim(author_email)) END AS email FROM commits)",
    "pairs AS (SELECT DISTINCT name_key, email FROM authored WHERE email IS NOT NULL)",
    "n0 AS (SELECT DISTINCT name_key, name_key AS person_key FROM authored)",
    *[f"n{k} AS (SELECT n.name_key, least(n.person_key, coalesce(min(m.least), n.person_key)) AS person_key FROM n{k - 1} n LEFT JOIN (SELECT p.name_key, e.least FROM pairs p JOIN (SELECT p.email, min(n.person_key) AS least FROM pairs p JOIN n{k - 1} n USING (name_key) GROUP BY p.email) e USING (email)) m USING (name_key) GROUP BY n.name_key, n.person_key)" for k in range(1, 5)],
    "names AS (SELECT * FROM n4)",
    "persons AS (SELECT person_key, max_by(author_name, committed_at::VARCHAR || lpad((999999999999 - id)::VARCHAR, 12, '0')) AS person, count(*) AS commits, max(committed_at) AS last_commit_at, max(committed_at) >= (SELECT max(committed_at) FROM commits) - INTERVAL 365 DAY AS active FROM authored JOIN names USING (name_key) GROUP BY person_key)",
])


@register("a10_people", "SELECT person_key, person, commits, strftime(last_commit_at, '%Y-%m-%d') AS last_day, active FROM persons", PEOPLE_CTES)
def persons(h: History) -> DataFrame:
    table = people.people(h.commits, people.identities(h.commits))
    return table.select("person_key", "person", "commits", F.date_format("last_commit_at", "yyyy-MM-dd").alias("last_day"), "active")


OWNERSHIP_CTES = ",\n".join([
    LINEAGE_CTES, PEOPLE_CTES,
    f"by_commit AS (SELECT root, path, commit_id, sum(coalesce(additions + coalesce(deletions, 0), 0)) AS lines FROM content WHERE {RANKABLE_SQL} GROUP BY 1, 2, 3)",
    "by_person AS (SELECT b.root AS file_id, b.path, n.person_key, count(*) AS commits, cast(sum(lines) AS bigint) AS churn FROM by_commit b JOIN authored a ON a.id = b.commit_id JOIN names n USING (name_key) GROUP BY 1, 2, 3)",
    "shared AS (SELECT b.*, p.person, p.active, " + ROUND3.format("CASE WHEN sum(b.churn) OVER w > 0 THEN b.churn / sum(b.churn) OVER w ELSE b.commits / sum(b.commits) OVER w END") + " AS share FROM by_person b JOIN persons p USING (person_key) WINDOW w AS (PARTITION BY b.file_id))",
    "owned AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY share DESC, commits DESC, person, person_key) AS place FROM shared)",
])


def _owned(h: History) -> DataFrame:
    rows = activity.lineage_changes(h.files, h.dated_changes).where(activity.rankable())
    names = people.identities(h.commits)
    return people.ownership(rows, h.commits, names, people.people(h.commits, names))


@register("a8_ownership", "SELECT file_id, path, person, commits, churn, share, place, place = 1 AND share >= 0.75 AND NOT active AS at_risk FROM owned", OWNERSHIP_CTES, recursive=True)
def ownership(h: History) -> DataFrame:
    return _owned(h).select("file_id", "path", "person", "commits", "churn", "share", F.col("place").cast("bigint").alias("place"), "at_risk")


TRUCK_CTES = OWNERSHIP_CTES + """,
knowers AS (SELECT DISTINCT file_id, person FROM owned WHERE place = 1 OR share >= 0.25),
standing AS (SELECT person, row_number() OVER (ORDER BY count(*) DESC, person) AS place FROM knowers GROUP BY person),
lost AS (SELECT file_id, max(s.place) AS spot FROM knowers JOIN standing s USING (person) GROUP BY file_id)"""


@register("a9_truck_factor", "SELECT place, person FROM standing WHERE place <= (SELECT min(spot) FROM (SELECT spot, sum(count(*)) OVER (ORDER BY spot) AS orphaned FROM lost GROUP BY spot) o WHERE orphaned * 2 > (SELECT count(*) FROM lost))", TRUCK_CTES, recursive=True)
def truck_factor(h: History) -> DataFrame:
    return people.truck_factor(_owned(h)).select(F.col("place").cast("bigint").alias("place"), "person")


FIX_CTES = DEFECT_CTES + """,
fixes AS (SELECT v.symbol_id, count(*) AS prior_changes, count(d.commit_id) AS fixes, max(CASE d.level WHEN 'INFERRED' THEN 2 WHEN 'DERIVED' THEN 1 WHEN 'FACT' THEN 0 END) AS rank
  FROM (SELECT DISTINCT symbol_id, commit_id FROM symbol_versions) v LEFT JOIN defects d USING (commit_id) GROUP BY v.symbol_id)"""


def _story_symbols(h: History) -> DataFrame:
    path = F.col("path")
    live = h.files.where("NOT deleted").where(activity.rankable() & ~paths.is_declaration(path) & ~paths.is_illustrative(path)).select(F.col("id").alias("file_id"), "path")
    return h.symbols.where("current AND kind <> 'variable'").join(live, "file_id")


STORY_SYMBOLS_SQL = f"(SELECT s.*, f.path FROM symbols s JOIN files f ON s.file_id = f.id WHERE s.current AND s.kind <> 'variable' AND NOT f.deleted AND {RANKABLE_SQL} AND NOT {DECLARATION_SQL} AND NOT {ILLUSTRATIVE_SQL})"


@register("a13_fixed_symbols", f"SELECT s.id, s.path, s.qualified_name, x.prior_changes, x.fixes, CASE x.rank WHEN 2 THEN 'INFERRED' WHEN 1 THEN 'DERIVED' ELSE 'FACT' END AS level FROM {STORY_SYMBOLS_SQL} s JOIN fixes x ON s.id = x.symbol_id WHERE x.fixes > 0", FIX_CTES)
def fixed_symbols(h: History) -> DataFrame:
    found = activity.fix_histories(_story_symbols(h), h.symbol_versions, activity.classify_defects(h.commits, h.discussions))
    return found.select("id", "path", "qualified_name", "prior_changes", "fixes", "level")


@register("a12_fragile_symbols", """
SELECT t.id, x.prior_changes, x.fixes FROM (SELECT DISTINCT s.id FROM symbols s JOIN symbol_versions v ON v.symbol_id = s.id WHERE s.current AND v.commit_id % 20 = 0) t
JOIN (SELECT v.symbol_id, count(*) AS prior_changes, count(d.commit_id) AS fixes FROM (SELECT DISTINCT symbol_id, commit_id FROM symbol_versions WHERE commit_id % 20 <> 0) v LEFT JOIN defects d USING (commit_id) GROUP BY 1) x ON t.id = x.symbol_id WHERE x.fixes > 0""", DEFECT_CTES)
def fragile(h: History) -> DataFrame:
    """Symbols that a range of commits changes and that broke before; the range itself is no history."""
    in_range = h.commits.where("id % 20 = 0").select(F.col("id").alias("commit_id"))
    touched = h.symbol_versions.join(in_range, "commit_id", "left_semi").select(F.col("symbol_id").alias("id")).distinct()
    symbols = h.symbols.where("current").join(touched, "id", "left_semi")
    return activity.fix_histories(symbols, h.symbol_versions, activity.classify_defects(h.commits, h.discussions), in_range).select("id", "prior_changes", "fixes")


ORIGIN_SQL = """
WITH RECURSIVE chain AS (SELECT source_id AS id, target_id AS origin, confidence::DOUBLE AS confidence, level = 'INFERRED' AS inferred, 1 AS hops FROM relations WHERE relation = 'COPIED_FROM'
  UNION ALL SELECT c.id, r.target_id, least(c.confidence, r.confidence), c.inferred OR r.level = 'INFERRED', c.hops + 1 FROM chain c JOIN relations r ON r.relation = 'COPIED_FROM' AND r.source_id = c.origin WHERE c.hops < 10)
"""
ORIGIN_CTES = """chain AS (SELECT source_id AS id, target_id AS origin, confidence::DOUBLE AS confidence, level = 'INFERRED' AS inferred, 1 AS hops FROM relations WHERE relation = 'COPIED_FROM'
  UNION ALL SELECT c.id, r.target_id, least(c.confidence, r.confidence::DOUBLE), c.inferred OR r.level = 'INFERRED', c.hops + 1 FROM chain c JOIN relations r ON r.relation = 'COPIED_FROM' AND r.source_id = c.origin WHERE c.hops < 10),
ends AS (SELECT id, arg_max(origin, hops) AS origin, min(confidence) AS confidence, bool_or(inferred) AS inferred, max(hops) AS hops FROM chain GROUP BY id),
introduced AS (SELECT source_id AS id, target_id AS commit_id, confidence::DOUBLE AS confidence, level FROM relations WHERE relation = 'INTRODUCED_BY'),
origins AS (SELECT s.id, i.commit_id, least(i.confidence, coalesce(e.confidence, 1.0)) AS confidence, CASE WHEN e.inferred THEN 'INFERRED' ELSE i.level END AS level, e.id IS NOT NULL AS copied FROM symbols s LEFT JOIN ends e ON s.id = e.id JOIN introduced i ON i.id = coalesce(e.origin, s.id) WHERE s.current)"""


@register("a15_symbol_origins", "SELECT id, commit_id, confidence, level, copied FROM origins", ORIGIN_CTES, recursive=True)
def origins(h: History) -> DataFrame:
    return intent.symbol_origins(h.symbols.where("current"), h.relations)


@register("a14_fossils", f"""
SELECT s.id, s.path, s.qualified_name, strftime(m.committed_at, '%Y-%m-%d') AS introduced, o.level, o.confidence, coalesce(h.changes_since, 0) AS changes_since
FROM {STORY_SYMBOLS_SQL} s JOIN origins o ON s.id = o.id JOIN commits m ON m.id = o.commit_id
LEFT JOIN (SELECT v.symbol_id, count(*) AS changes_since FROM (SELECT DISTINCT symbol_id, commit_id FROM symbol_versions) v JOIN (
  SELECT o.id, CASE WHEN o.copied THEN (SELECT arg_min(v.commit_id, k.committed_at::VARCHAR || lpad(v.commit_id::VARCHAR, 12, '0')) FROM symbol_versions v JOIN commits k ON k.id = v.commit_id WHERE v.symbol_id = o.id) ELSE o.commit_id END AS arrival FROM origins o) a ON a.id = v.symbol_id AND v.commit_id <> a.arrival GROUP BY 1) h ON h.symbol_id = s.id
ORDER BY m.committed_at, s.path, s.start_line, s.id LIMIT 50""", ORIGIN_CTES, recursive=True)
def fossils(h: History) -> DataFrame:
    table = intent.fossils(_story_symbols(h), intent.symbol_origins(h.symbols.where("current"), h.relations), h.symbol_versions, h.commits)
    top = table.orderBy("committed_at", "path", "start_line", "id").limit(50)
    return top.select("id", "path", "qualified_name", F.date_format("committed_at", "yyyy-MM-dd").alias("introduced"), "level", "confidence", "changes_since")


@register("a17_runtime_minimums", "SELECT 'node' AS runtime, 18 AS major, 0 AS minor UNION ALL SELECT 'python', 3, 8 UNION ALL SELECT 'go', 1, 20 FROM (SELECT count(*) FROM files) f")
def runtime_minimums(h: History) -> DataFrame:
    """Constraints as manifests of the files declare them; the lowest of each runtime counts."""
    constraint = F.when(F.col("id") % 4 == 0, F.lit(">=20 <23")).when(F.col("id") % 4 == 1, F.lit("^18 || ^20.1")).when(F.col("id") % 4 == 2, F.lit(">=3.8,<3.13")).otherwise(F.lit("1.20"))
    runtime = F.when(F.col("id") % 4 < 2, "node").when(F.col("id") % 4 == 2, "python").otherwise("go")
    declared = h.files.select(runtime.alias("runtime"), text.minimum_version(constraint).alias("v")).distinct()
    return declared.groupBy("runtime").agg(F.min("v").alias("v")).select("runtime", "v.major", "v.minor")


INTENT_CTES = f"""breadth AS (SELECT commit_id, count(*) AS n FROM changes GROUP BY commit_id),
flagged AS (SELECT m.id AS commit_id, m.committed_at, m.subject LIKE '%Node 14%' OR m.subject LIKE '%Python 2.7%' OR m.subject LIKE '%Go 1.18%' AS old_version, m.subject LIKE '%until 2024-06%' AS overdue
  FROM commits m JOIN breadth b ON b.commit_id = m.id AND b.n <= 20 WHERE m.subject IN ('Add temporary workaround for Node 14 until 2024-06', 'Add shim for Python 2.7', 'legacy path for Go 1.18, expires on Q1 2030')),
targets AS (SELECT c.file_id, count(DISTINCT f.commit_id) AS reasons, min(f.committed_at) AS first_at, max(f.committed_at) AS last_flagged, bool_or(old_version) AS old_version, bool_or(overdue) AS overdue
  FROM flagged f JOIN changes c ON c.commit_id = f.commit_id AND c.status <> 'deleted' JOIN files x ON x.id = c.file_id WHERE NOT x.deleted AND {RANKABLE_SQL} AND NOT {ILLUSTRATIVE_SQL} GROUP BY c.file_id),
later AS (SELECT t.file_id, count(*) FILTER (d.committed_at > t.last_flagged) AS reworked, max(d.committed_at) AS last_at FROM targets t JOIN dated_changes d USING (file_id) GROUP BY t.file_id)"""


@register("a16_dead_intent", "SELECT t.file_id, t.reasons, strftime(t.first_at, '%Y-%m-%d') AS first_day, floor(least(0.8, 0.3 + CASE WHEN old_version THEN 0.25 ELSE 0 END + CASE WHEN overdue THEN 0.2 ELSE 0 END + CASE WHEN last_at <= TIMESTAMP '2025-01-01' - INTERVAL 365 DAY THEN 0.1 ELSE 0 END) * 100 + 0.5) / 100 AS confidence FROM targets t JOIN later l USING (file_id) WHERE l.reworked < 3", INTENT_CTES)
def dead_intent(h: History) -> DataFrame:
    minimums = h.spark.createDataFrame([("node", 18, 0), ("python", 3, 8), ("go", 1, 20)], "runtime string, major int, minor int")
    table = intent.dead_intent(h.files, h.dated_changes, h.commits, minimums, now="2025-01-01")
    return table.select("file_id", "reasons", F.date_format("first_at", "yyyy-MM-dd").alias("first_day"), "confidence")


def _dead(h: History) -> DataFrame:
    minimums = h.spark.createDataFrame([("node", 18, 0), ("python", 3, 8), ("go", 1, 20)], "runtime string, major int, minor int")
    return intent.dead_intent(h.files, h.dated_changes, h.commits, minimums, now="2025-01-01")


@register("o5_dead_intent_order", "SELECT path, confidence, first_day FROM (SELECT f.path, t.first_at, strftime(t.first_at, '%Y-%m-%d') AS first_day, floor(least(0.8, 0.3 + CASE WHEN old_version THEN 0.25 ELSE 0 END + CASE WHEN overdue THEN 0.2 ELSE 0 END + CASE WHEN last_at <= TIMESTAMP '2025-01-01' - INTERVAL 365 DAY THEN 0.1 ELSE 0 END) * 100 + 0.5) / 100 AS confidence FROM targets t JOIN later l USING (file_id) JOIN files f ON f.id = t.file_id WHERE l.reworked < 3) d ORDER BY confidence DESC, first_at, path LIMIT 50", INTENT_CTES)
def dead_intent_order(h: History) -> DataFrame:
    """The surest first, then the oldest, then by path."""
    top = _dead(h).join(h.files.select(F.col("id").alias("file_id"), "path"), "file_id").orderBy(F.desc("confidence"), "first_at", "path").limit(50)
    return top.select("path", "confidence", F.date_format("first_at", "yyyy-MM-dd").alias("first_day"))


@register("o4_longest_untouched", f"SELECT s.id, s.path, strftime(max(m.committed_at), '%Y-%m-%d') AS last_day FROM {STORY_SYMBOLS_SQL} s JOIN symbol_versions v ON v.symbol_id = s.id JOIN commits m ON m.id = v.commit_id GROUP BY s.id, s.path, s.start_line ORDER BY max(m.committed_at), s.path, s.start_line, s.id LIMIT 20")
def longest_untouched(h: History) -> DataFrame:
    return intent.longest_untouched(_story_symbols(h), h.symbol_versions, h.commits).select("id", "path", F.date_format("last_at", "yyyy-MM-dd").alias("last_day"))



@register("a18_touched_symbols", """
SELECT s.id, CASE WHEN bool_and(v.commit_id % 10 = 0) THEN CASE WHEN max(e.source_id) IS NOT NULL THEN 'copied' ELSE 'new' END ELSE 'changed' END AS change, coalesce(max(k.callers), 0) AS callers
FROM symbols s JOIN symbol_versions v ON v.symbol_id = s.id LEFT JOIN relations e ON e.relation = 'COPIED_FROM' AND e.source_id = s.id
LEFT JOIN (SELECT target_id, count(DISTINCT source_id) AS callers FROM relations WHERE relation = 'CALLS' AND source_id <> target_id GROUP BY 1) k ON k.target_id = s.id
WHERE s.current AND s.kind <> 'variable' GROUP BY s.id HAVING bool_or(v.commit_id % 10 = 0)""")
def touched(h: History) -> DataFrame:
    in_range = h.commits.where("id % 10 = 0").select(F.col("id").alias("commit_id"))
    return intent.touched_symbols(h.symbols.where("current AND kind <> 'variable'"), h.symbol_versions, h.relations, in_range)


@register("o10_touched_order", """
SELECT t.id, t.change, f.path, s.start_line, hit / found AS share FROM (
SELECT v.symbol_id AS id, CASE WHEN bool_and(v.commit_id % 10 = 0) THEN CASE WHEN v.symbol_id IN (SELECT source_id FROM relations WHERE relation = 'COPIED_FROM') THEN 'copied' ELSE 'new' END ELSE 'changed' END AS change FROM symbol_versions v GROUP BY v.symbol_id HAVING bool_or(v.commit_id % 10 = 0)) t
JOIN symbols s ON s.id = t.id AND s.current AND s.kind <> 'variable' JOIN files f ON f.id = s.file_id
LEFT JOIN (SELECT s.id, len(list_filter(range(1, v.n_found * 3, 3), lambda x: x BETWEEN s.start_line AND s.end_line)) AS found, len(list_filter(range(1, v.n_found * 3, 3), lambda x: x BETWEEN s.start_line AND s.end_line AND x % v.step <> 0)) AS hit FROM symbols s JOIN line_coverage v USING (file_id) WHERE v.fresh) c ON c.id = t.id AND c.found > 0
ORDER BY CASE change WHEN 'new' THEN 0 WHEN 'copied' THEN 3 ELSE 4 END, coalesce(hit / found, 2), f.path, s.start_line, t.id LIMIT 500""")
def touched_order(h: History) -> DataFrame:
    """Symbols that every tenth commit touches, as the report shows them."""
    lines = h.line_coverage.where("fresh").select("file_id", "step", F.sequence(F.lit(1), F.col("n_found") * 3 - 1, F.lit(3)).alias("lines"))
    inside = h.symbols.join(lines, "file_id").withColumn("inside", F.expr("filter(lines, x -> x BETWEEN start_line AND end_line)"))
    covered = inside.select("id", F.size("inside").alias("found"), F.expr("size(filter(inside, x -> x % step <> 0))").alias("hit"))
    places = h.symbols.join(h.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "path", "start_line")
    return intent.top_touched(touched(h).drop("callers"), places, covered, 500)


@register("o9_changed_by_impact", "SELECT path, count(DISTINCT w.node) AS impact FROM (SELECT DISTINCT f.id, f.path FROM changes c JOIN files f ON f.id = c.file_id WHERE c.commit_id > (SELECT max(id) - 100 FROM commits) ORDER BY f.path LIMIT 25) c LEFT JOIN reached w ON w.root = c.id GROUP BY c.id, path", reach_ctes("SELECT source, target FROM imports"), recursive=True)
def changed_by_impact(h: History) -> DataFrame:
    """Files of the last hundred commits: the first 25 by path, those that most depend on first."""
    last = h.commits.agg((F.max("id") - 100).alias("since"))
    changed = h.changes.join(F.broadcast(last), F.col("commit_id") > F.col("since")).select("file_id").distinct().join(h.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return intent.changed_by_impact(changed, h.imports.select("source", "target").distinct().withColumn("confidence", F.lit(1.0)))


#: Stories by ``key`` over rows (key, commit_id) and calls (key, caller).
STORY_SQL = """SELECT key AS {name}, sum(n)::BIGINT AS changes, count(*) AS authors, sum(fix)::BIGINT AS fixes, coalesce(any_value(callers), 0) AS callers, string_agg(person || ' ' || share, '; ' ORDER BY place) FILTER (place <= 3) AS owners, strftime(min(first_at), '%Y-%m-%d') AS first_day, strftime(max(last_at), '%Y-%m-%d') AS last_day
FROM (SELECT b.*, p.person, floor(b.n / sum(b.n) OVER (PARTITION BY b.key) * 1000 + 0.5) / 1000 AS share, row_number() OVER (PARTITION BY b.key ORDER BY b.n DESC, p.person, b.person_key) AS place FROM (
  SELECT key, n.person_key, count(*) AS n, count(d.commit_id) AS fix, min(a.committed_at) AS first_at, max(a.committed_at) AS last_at FROM touched t JOIN authored a ON a.id = t.commit_id JOIN names n USING (name_key) LEFT JOIN defects d ON d.commit_id = t.commit_id GROUP BY 1, 2) b JOIN persons p USING (person_key)) o
LEFT JOIN (SELECT key, count(DISTINCT caller) AS callers FROM called GROUP BY key) c USING (key) GROUP BY key"""


def story_ctes(key: str = "v.symbol_id", join: str = "", called: str = "r.target_id", call_join: str = "") -> str:
    return f"""{DEFECT_CTES},
{PEOPLE_CTES},
touched AS (SELECT DISTINCT {key} AS key, v.commit_id FROM symbol_versions v {join}),
called AS (SELECT {called} AS key, r.source_id AS caller FROM relations r {call_join} WHERE r.relation = 'CALLS')"""


def called_symbols(h: History) -> DataFrame:
    return h.relations.where("relation = 'CALLS' AND target_type = 'symbol'").select(F.col("target_id").alias("symbol_id"), F.col("source_id").alias("caller"))


def stories_of(h: History, versions: DataFrame, calls: DataFrame) -> DataFrame:
    names = people.identities(h.commits)
    return intent.symbol_stories(versions, h.commits, activity.classify_defects(h.commits, h.discussions), names, people.people(h.commits, names), calls)


@register("a19_symbol_story", STORY_SQL.format(name="symbol_id"), story_ctes())
def story(h: History) -> DataFrame:
    return stories_of(h, h.symbol_versions, called_symbols(h))


@register("a22_import_collapse", "SELECT source, target, max(0.9 - method * 0.1) AS confidence, string_agg(DISTINCT 'm' || method, '+' ORDER BY 'm' || method) AS methods FROM imports GROUP BY source, target")
def import_collapse(h: History) -> DataFrame:
    methods = F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("m"), F.col("method").cast("string")))), "+")
    return h.imports.groupBy("source", "target").agg(F.max(F.lit(0.9).cast("decimal(11,1)") - F.col("method") * F.lit(0.1).cast("decimal(2,1)")).cast("double").alias("confidence"), methods.alias("methods"))


@register("a27_site_statistics", "SELECT count(*) AS commits, count(DISTINCT author_name) AS authors, min(year(committed_at))::INT AS first_year, max(year(committed_at))::INT AS last_year FROM commits")
def statistics(h: History) -> DataFrame:
    return h.commits.agg(F.count("*").alias("commits"), F.countDistinct("author_name").alias("authors"), F.min(F.year("committed_at")).alias("first_year"), F.max(F.year("committed_at")).alias("last_year"))


@register("a28_commit_breadth", "SELECT n AS files, count(*) AS commits FROM (SELECT commit_id, count(*) AS n FROM changes GROUP BY commit_id) b GROUP BY n")
def breadth(h: History) -> DataFrame:
    return h.changes.groupBy("commit_id").agg(F.count("*").alias("files")).groupBy("files").agg(F.count("*").alias("commits"))


@register("a29_file_symbols", "SELECT s.file_id, s.id, count(v.commit_id) AS versions, max(i.confidence)::DOUBLE AS sure FROM symbols s LEFT JOIN symbol_versions v ON v.symbol_id = s.id LEFT JOIN relations i ON i.relation = 'INTRODUCED_BY' AND i.source_id = s.id GROUP BY 1, 2")
def file_symbols(h: History) -> DataFrame:
    versions = h.symbol_versions.groupBy(F.col("symbol_id").alias("id")).agg(F.count("*").alias("versions"))
    sure = h.relations.where("relation = 'INTRODUCED_BY'").groupBy(F.col("source_id").alias("id")).agg(F.max("confidence").cast("double").alias("sure"))
    return h.symbols.select("file_id", "id").join(versions, "id", "left").join(sure, "id", "left").fillna(0, ["versions"]).select("file_id", "id", "versions", "sure")


@register("o2_top_owners", "SELECT file_id, path, churn, at_risk FROM (SELECT file_id, path, sum(churn)::BIGINT AS churn, bool_or(place = 1 AND share >= 0.75 AND NOT active) AS at_risk FROM owned GROUP BY 1, 2) o ORDER BY at_risk DESC, churn DESC, path LIMIT 20", OWNERSHIP_CTES, recursive=True)
def top_owners(h: History) -> DataFrame:
    files = _owned(h).groupBy("file_id", "path").agg(F.sum("churn").alias("churn"), F.bool_or("at_risk").alias("at_risk"))
    return files.orderBy(F.desc("at_risk"), F.desc("churn"), "path").limit(20)


@register("a21_change_report", "SELECT c.commit_id, count(DISTINCT c.file_id) AS files, max(s.score) AS top_score, min(s.place) AS top_place FROM changes c JOIN (SELECT file_id, score, row_number() OVER (ORDER BY score DESC, commits DESC, path) AS place FROM scored) s ON s.file_id = c.file_id GROUP BY c.commit_id", HOTSPOT_CTES, recursive=True)
def change_report(h: History) -> DataFrame:
    """For every commit: how the files it changes rank among the hotspots."""
    table = _hotspots(h)
    wanted = h.changes.select("commit_id", "file_id")
    # A file's place is one more than the files ahead of it; counted by score first, so that only
    # files of equal score are numbered together.
    ahead = table.groupBy("score").agg(F.count("*").alias("n"))
    before = ahead.withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.desc("commits"), "path"))
    placed = table.withColumn("within", place).join(before.select("score", "ahead"), "score").select("file_id", "score", (F.col("ahead") + F.col("within")).alias("place"))
    return wanted.join(placed, "file_id").groupBy("commit_id").agg(F.countDistinct("file_id").alias("files"), F.max("score").alias("top_score"), F.min("place").alias("top_place"))
