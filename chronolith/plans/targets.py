"""What inputs name, how fresh an index is, and what depends on a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import commit_graph, graph, linking, search
from ..sources.driver_tables import History
from .ancestry import graph_of
from .reads import TEST_SQL
from .registry import register

INPUT_CTES = """inputs AS (
SELECT DISTINCT substr(body, 21, 12) AS input FROM commits WHERE body LIKE 'This reverts commit %' UNION SELECT ' #' || number FROM discussions WHERE provider = 'github' UNION SELECT 'gh-' || number FROM discussions WHERE type = 'pull_request'
UNION SELECT replace(path, '/', chr(92)) FROM files UNION SELECT f.path || ':' || s.name FROM symbols s JOIN files f ON f.id = s.file_id UNION SELECT qualified_name FROM symbols UNION SELECT ecosystem || ':' || name FROM dependencies UNION SELECT 'abc' UNION SELECT '  '),
given AS (SELECT input, trim(input) AS t FROM inputs WHERE trim(input) <> ''),
talk AS (SELECT DISTINCT type, commit_id % 500 + 1 AS id, number::BIGINT AS number FROM discussions WHERE provider = 'github'),
labels AS (SELECT id, file_id, current, name FROM symbols UNION SELECT id, file_id, current, qualified_name FROM symbols),
single AS (SELECT name FROM labels WHERE current GROUP BY name HAVING count(*) = 1),
tagged AS (SELECT *, regexp_matches(t, '^(.+\\.[A-Za-z0-9]+):([^/:]+)$') AS in_file, regexp_matches(t, '^(#|GH-)\\d+$', 'i') AS numbered, regexp_matches(t, '^(npm|go|cargo|pypi):(.+)$') AS dep FROM given)"""


@register("q6_resolve_target", """
SELECT input, type AS kind, id, 'issue or pull request number' AS how FROM tagged JOIN talk ON numbered AND number::VARCHAR = regexp_extract(t, '(\\d+)$', 1)
UNION SELECT input, 'dependency', d.id, 'dependency' FROM tagged JOIN dependencies d ON dep AND t = d.ecosystem || ':' || d.name
UNION SELECT input, 'commit', c.id, 'commit sha prefix' FROM tagged JOIN commits c ON regexp_matches(t, '^[0-9a-f]{7,64}$') AND substr(c.sha, 1, 12) = t
UNION SELECT input, 'file', f.id, 'file path' FROM tagged JOIN files f ON f.path = replace(t, chr(92), '/')
UNION SELECT input, 'symbol', l.id, 'symbol in file' FROM tagged JOIN files f ON in_file AND f.path = regexp_extract(t, '^(.+):', 1) JOIN labels l ON l.file_id = f.id AND l.name = regexp_extract(t, ':([^/:]+)$', 1)
UNION SELECT input, 'symbol', l.id, 'symbol name' FROM tagged JOIN labels l ON l.name = t AND NOT in_file AND NOT numbered AND NOT dep WHERE l.current OR l.name NOT IN (SELECT name FROM single)""", INPUT_CTES)
def resolve_target(h: History) -> DataFrame:
    """Hash prefixes as commits write them, numbers, dependencies, every path, every path:Symbol and every name."""
    text = lambda df, column: df.select(column.alias("input"))
    github = h.discussions.where("provider = 'github'")
    inputs = text(h.commits.where("body LIKE 'This reverts commit %'"), F.substring("body", 21, 12))
    inputs = inputs.unionByName(text(github, F.concat(F.lit(" #"), "number"))).unionByName(text(h.discussions.where("type = 'pull_request'"), F.concat(F.lit("gh-"), "number")))
    inputs = inputs.unionByName(text(h.files, F.replace("path", F.lit("/"), F.lit("\\")))).unionByName(text(h.symbols.join(h.files.select(F.col("id").alias("file_id"), "path"), "file_id"), F.concat("path", F.lit(":"), "name")))
    inputs = inputs.unionByName(text(h.symbols, F.col("qualified_name"))).unionByName(text(h.dependencies, F.concat("ecosystem", F.lit(":"), "name"))).unionByName(h.spark.createDataFrame([("abc",), ("  ",)], "input string"))
    talk = github.select("type", (F.col("commit_id") % 500 + 1).alias("id"), "number")
    return linking.resolve_targets(inputs.distinct(), h.commits, h.files, h.symbols, talk, h.dependencies)


@register("p6_dependencies_by_name", "SELECT id, ecosystem, name FROM dependencies WHERE name = 'hot-gear-37' ORDER BY ecosystem, id LIMIT 20")
def dependencies_by_name(h: History) -> DataFrame:
    return search.dependencies_by_name(h.dependencies, "hot-gear-37").select("id", "ecosystem", "name")


@register("p21_runtime_evidence", "SELECT id, split_part(locator, '#runtime:', 1) AS path, split_part(locator, '#runtime:', 2) AS runtime FROM evidence WHERE locator LIKE '%#runtime:%'")
def runtime_evidence(h: History) -> DataFrame:
    return search.runtime_evidence(h.evidence).select("id", "path", "runtime")


@register("j5_first_parents", "SELECT c.id, f.path, strftime(c.committed_at, '%Y-%m-%d') AS day, p.parent_id AS first_parent FROM dated_changes c JOIN files f ON f.id = c.file_id LEFT JOIN commit_parents p ON p.commit_id = c.commit_id AND p.ordinal = 0")
def first_parents(h: History) -> DataFrame:
    """Each change with the version that it is diffed against; a root commit has none."""
    first = h.commit_parents.where("ordinal = 0").select("commit_id", F.col("parent_id").alias("first_parent"))
    rows = h.dated_changes.join(h.files.select(F.col("id").alias("file_id"), "path"), "file_id").join(first, "commit_id", "left")
    return rows.select("id", "path", F.date_format("committed_at", "yyyy-MM-dd").alias("day"), "first_parent")


@register("q11_index_freshness", "SELECT who AS indexed_by, CASE WHEN indexed = head THEN 'current' WHEN indexed IS NULL THEN 'unindexed' WHEN indexed > (SELECT max(id) FROM commits) THEN 'unknown' WHEN EXISTS (SELECT 1 FROM back b WHERE b.id = indexed) THEN 'behind' ELSE 'diverged' END AS freshness FROM (SELECT o_custkey AS who, (SELECT max(id) FROM commits WHERE id % 32 = 0) AS head, CASE o_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN max(o_orderkey) + 1000000000 WHEN 2 THEN (SELECT max(id) FROM commits WHERE id % 32 = 0) ELSE max(o_orderkey) END AS indexed FROM orders GROUP BY o_custkey) i", "back AS (SELECT max(id) AS id FROM commits WHERE id % 32 = 0 UNION SELECT p.parent_id FROM back b JOIN commit_parents p ON p.commit_id = b.id)", recursive=True)
def freshness(h: History) -> DataFrame:
    """Each author's last commit taken for the commit that an index was built at; some have none, one that isn't here, or the head."""
    head = h.commits.where("id % 32 = 0").agg(F.max("id").alias("head"))
    last = h.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last")).crossJoin(F.broadcast(head))
    kind = F.col("o_custkey") % 10
    indexed = F.when(kind == 1, F.col("last") + 1000000000).when(kind == 2, F.col("head")).when(kind != 0, F.col("last"))
    states = last.select(F.col("o_custkey").alias("indexed_by"), indexed.alias("indexed"), "head")
    return commit_graph.index_freshness(states, *graph_of(h)).select("indexed_by", "freshness")


SYMBOL_IMPACT_CTES = f"""link AS (SELECT DISTINCT source, target FROM imports WHERE source <> target),
calls_in AS (SELECT target_id AS root, source_id AS node, confidence::DOUBLE AS c FROM relations WHERE relation = 'CALLS' AND source_id <> target_id),
walk AS (SELECT root, node, 1 AS distance FROM calls_in UNION SELECT w.root, k.node, w.distance + 1 FROM walk w JOIN calls_in k ON k.root = w.node WHERE w.distance < 5 AND k.node <> w.root),
near_calls AS (SELECT root, node, min(distance) AS distance FROM walk GROUP BY 1, 2),
defined AS (SELECT DISTINCT file_id, qualified_name FROM symbols WHERE current),
bound AS (SELECT b.file_id AS importer, b.target, b.imported, d.qualified_name IS NOT NULL AS known FROM import_bindings b LEFT JOIN defined d ON d.file_id = b.target AND d.qualified_name = b.imported),
uses AS (SELECT s.id AS root, l.source AS node FROM symbols s JOIN link l ON l.target = s.file_id WHERE NOT EXISTS (SELECT 1 FROM bound b WHERE b.importer = l.source AND b.target = l.target)
  UNION SELECT s.id, b.importer FROM symbols s JOIN bound b ON b.target = s.file_id AND b.importer <> s.file_id WHERE b.imported = '*' OR b.imported = s.qualified_name OR starts_with(s.qualified_name, b.imported || '.') OR starts_with(b.imported, s.qualified_name || '.') OR NOT b.known)"""


@register("q2_symbol_impact", f"""SELECT s.id, coalesce(c.direct, 0) AS direct_callers, coalesce(c.more, 0) AS transitive_callers, coalesce(u.n, 0) AS importers, coalesce(u.tests, 0) AS tests, coalesce(i.n, 0) - coalesce(u.n, 0) AS skipped,
CASE WHEN coalesce(c.direct, 0) = 0 THEN 'No call to it was resolved. ' ELSE c.direct || CASE WHEN c.direct = 1 THEN ' caller calls it directly and ' ELSE ' callers call it directly and ' END || c.more || ' through other calls. ' END || CASE WHEN coalesce(u.n, 0) = 0 THEN 'Nothing in the index depends on it.' ELSE u.n || CASE WHEN u.n = 1 THEN ' file imports' ELSE ' files import' END || ' the file that defines it (' || u.tests || ' of them tests).' END AS answer
FROM symbols s LEFT JOIN (SELECT root, count(*) FILTER (distance = 1) AS direct, count(*) FILTER (distance > 1) AS more FROM near_calls GROUP BY root) c ON c.root = s.id
LEFT JOIN (SELECT root, count(*) AS n, count(*) FILTER ({TEST_SQL}) AS tests FROM uses JOIN files ON files.id = uses.node GROUP BY root) u ON u.root = s.id LEFT JOIN (SELECT k.root, count(*) AS n FROM (SELECT s.id AS root, l.source FROM symbols s JOIN link l ON l.target = s.file_id JOIN files f ON f.id = l.source) k GROUP BY k.root) i ON i.root = s.id""", SYMBOL_IMPACT_CTES, recursive=True)
def symbol_impact(h: History) -> DataFrame:
    """Who calls each symbol, and which files import its file without naming only other things of it."""
    calls = h.relations.where("relation = 'CALLS' AND source_type = 'symbol'").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("confidence").cast("double").alias("confidence"))
    callers = graph.dependents(calls, 5)
    edges = h.imports.select("source", "target").distinct()
    users = graph.symbol_importers(h.symbols, edges, h.import_bindings.select(F.col("file_id").alias("source"), "target", "imported"), h.symbols.where("current"))
    return graph.symbol_impact(h.symbols, callers, users.join(h.files.select(F.col("id").alias("node"), paths.is_test(F.col("path")).alias("is_test")), "node"))


@register("o6_dependents", "SELECT root, node, place FROM (SELECT h.root, h.node, row_number() OVER (PARTITION BY h.root ORDER BY h.distance, f.path, h.node) AS place FROM (SELECT root, node, min(distance) AS distance FROM hop GROUP BY 1, 2) h JOIN files f ON f.id = h.node) p WHERE place <= 20", "hop AS (SELECT target AS root, source AS node, 1 AS distance FROM (SELECT DISTINCT source, target FROM imports) i WHERE source <> target UNION SELECT h.root, i.source, h.distance + 1 FROM hop h JOIN (SELECT DISTINCT source, target FROM imports WHERE source <> target) i ON i.target = h.node WHERE h.distance < 5 AND i.source <> h.root)", recursive=True)
def dependents(h: History) -> DataFrame:
    """The twenty nearest dependents of each file, by distance, then path."""
    found = graph.dependents(h.imports.select("source", "target").distinct().withColumn("confidence", F.lit(0.95)), 5).join(h.files.select(F.col("id").alias("node"), "path"), "node")
    place = F.row_number().over(Window.partitionBy("root").orderBy("distance", "path", "node"))
    return found.withColumn("place", place).where("place <= 20").select("root", "node", F.col("place").cast("long").alias("place"))


@register("e9_followed_symbols")
def followed_symbols(h: History) -> DataFrame:
    """Where each symbol is after all renames; what the new file holds decides one by one, which SQL can't say."""
    born = h.symbol_versions.join(h.commits.select(F.col("id").alias("commit_id"), "committed_at"), "commit_id").groupBy(F.col("symbol_id").alias("id")).agg(F.min("committed_at").alias("born_at"))
    renames = h.dated_changes.where("status = 'renamed' AND previous_file_id IS NOT NULL").select(F.col("id").alias("rename_id"), F.col("previous_file_id").alias("from_id"), F.col("file_id").alias("to_id"), F.col("committed_at").alias("at"))
    return search.follow_renames(h.symbols.select("id", "file_id").join(born, "id"), renames)
