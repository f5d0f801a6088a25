"""Link builders and import resolution as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import imports, linkers
from ..sources.driver_tables import History
from .registry import register


@register("e18_commit_references", """
SELECT s.id AS commit_id, s.number, CASE WHEN s.closing AND o.id IS NULL THEN 'RESOLVED_BY' ELSE 'REFERENCES' END AS relation, 'DERIVED' AS level, CASE WHEN s.closing AND o.id IS NULL THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence
FROM (SELECT id, id % 500 + 1 AS number, id % 7 = 0 AS closing FROM commits WHERE id % 7 IN (0, 1)) s
JOIN (SELECT DISTINCT cast(number AS BIGINT) AS number FROM discussions WHERE type = 'issue' AND provider = 'github') k USING (number) LEFT JOIN reverted o ON o.id = s.id""",
"""reverted AS (SELECT id FROM commits WHERE subject LIKE 'Revert "%' OR body LIKE 'This reverts commit%'
UNION SELECT m.id FROM commits c JOIN commits m ON c.body LIKE 'This reverts commit%' AND starts_with(m.sha, regexp_extract(c.body, 'This reverts commit ([0-9a-f]{7,40})', 1)))""")
def commit_references(h: History) -> DataFrame:
    issues = h.discussions.where("type = 'issue' AND provider = 'github'").select(F.col("number").cast("bigint").alias("number"))
    return linkers.commit_references(h.commits, issues, "own", "repo")


@register("e22_foreign_references", "SELECT 'acme/tools' AS repo, 7::BIGINT AS number FROM commits WHERE id % 7 = 1 LIMIT 1")
def foreign_references(h: History) -> DataFrame:
    looked_up = h.spark.createDataFrame([("acme/other", 7)], "repo string, number bigint")
    return linkers.foreign_references(h.commits, looked_up, "own", "repo")


@register("e21_tracker_links", "SELECT c.id AS commit_id, 'PROJ-' || (c.id % 90 + 1) AS number FROM commits c WHERE c.id % 7 = 3 AND 'PROJ-' || (c.id % 90 + 1) IN (SELECT number FROM discussions WHERE provider = 'jira')")
def tracker_links(h: History) -> DataFrame:
    return linkers.tracker_links(h.commits, h.discussions.where("provider = 'jira'"))


_PAIRS = "SELECT b.commit_id, b.symbol_id AS born, r.symbol_id AS removed FROM lineage_sides b JOIN lineage_sides r ON b.commit_id = r.commit_id AND b.kind = r.kind AND b.born AND NOT r.born AND {fits}"
_ALONE = "SELECT commit_id, born, removed FROM (SELECT *, count(*) OVER (PARTITION BY commit_id, born) AS n, count(*) OVER (PARTITION BY commit_id, removed) AS m FROM ({pairs}) p) x WHERE n = 1 AND m = 1"
_FREE = " WHERE (b.commit_id, b.symbol_id) NOT IN (SELECT (commit_id, born) FROM {0}) AND (r.commit_id, r.symbol_id) NOT IN (SELECT (commit_id, removed) FROM {0})"
_LINEAGE = f"""moved AS ({_ALONE.format(pairs=_PAIRS.format(fits="b.file_id <> r.file_id AND b.qualified_name = r.qualified_name AND b.shape = r.shape"))}),
renamed AS ({_ALONE.format(pairs=_PAIRS.format(fits="b.file_id = r.file_id AND b.shape = r.shape") + _FREE.format("moved"))}),
earlier AS (SELECT * FROM moved UNION ALL SELECT * FROM renamed),
edited AS ({_ALONE.format(pairs=_PAIRS.format(fits="b.file_id <> r.file_id AND b.qualified_name = r.qualified_name") + _FREE.format("earlier"))})"""


@register("e7_symbol_lineage", "SELECT *, 'moved' AS method, 'DERIVED' AS level, 0.9::DOUBLE AS confidence FROM moved UNION ALL SELECT *, 'renamed', 'DERIVED', 0.9::DOUBLE FROM renamed UNION ALL SELECT *, 'moved-with-edits', 'INFERRED', 0.6::DOUBLE FROM edited", _LINEAGE)
def symbol_lineage(h: History) -> DataFrame:
    return linkers.symbol_lineage(h.lineage_sides.where("born"), h.lineage_sides.where("NOT born"))


@register("e12_relative_imports", """
SELECT i.source * 1000000 + i.target AS import_id, t.path AS target FROM (SELECT DISTINCT source, target FROM imports) i JOIN files s ON s.id = i.source JOIN files t ON t.id = i.target
WHERE regexp_extract(s.path, '^(.*)/', 1) = regexp_extract(t.path, '^(.*)/', 1)""")
def relative_imports(h: History) -> DataFrame:
    """Imports between files of one directory, written as relative specifiers without what may be left out."""
    f = h.files.select("id", "path")
    pairs = h.imports.select("source", "target").distinct().join(f.select(F.col("id").alias("source"), "path"), "source").join(f.select(F.col("id").alias("target"), F.col("path").alias("to")), "target")
    near = pairs.where("substring_index(path, '/', size(split(path, '/')) - 1) = substring_index(to, '/', size(split(to, '/')) - 1)")
    written = F.concat(F.lit("./"), F.regexp_replace(F.substring_index("to", "/", -1), r"(\.d)?\.(ts|json)$", ""))
    rows = near.select((F.col("source") * 1000000 + F.col("target")).alias("import_id"), "path", written.alias("specifier"))
    return imports.relative_imports(rows, h.files).select("import_id", "target")


@register("e13_python_modules", """
SELECT module, target, confidence::DOUBLE AS confidence FROM (SELECT replace(replace(path, '.py', ''), '/', '.') AS module, path AS target, 1.0 AS confidence FROM files WHERE path LIKE '%.py'
UNION ALL SELECT module, min(path), 0.9 FROM (SELECT path, array_to_string(list_slice(string_split(replace(path, '.py', ''), '/'), k, 9), '.') AS module FROM files, range(2, 9) r(k) WHERE path LIKE '%.py' AND k <= len(string_split(path, '/'))) e GROUP BY module HAVING count(*) = 1) m""")
def python_modules(h: History) -> DataFrame:
    return imports.python_modules(h.files)


@register("e14_longest_prefix", "SELECT id AS import_id, CASE WHEN path LIKE 'src/tests/%' THEN 'src/tests' WHEN path LIKE 'src/%' THEN 'src' ELSE 'dist' END AS name FROM files WHERE path LIKE 'src/%' OR path LIKE 'dist/%'")
def longest_prefix(h: History) -> DataFrame:
    known = h.spark.createDataFrame([("src",), ("src/tests",), ("dist",), ("do",)], "name string")
    return imports.longest_prefix(h.files.select(F.col("id").alias("import_id"), F.col("path").alias("specifier")), known)


@register("x17_path_patterns", "SELECT id AS import_id, CASE WHEN path LIKE 'src/promo/%' THEN 'lib/promo-' || substr(path, 11) ELSE 'all/' || substr(path, 5) END AS target FROM files WHERE path LIKE 'src/%'")
def path_patterns(h: History) -> DataFrame:
    patterns = h.spark.createDataFrame([("src/*", "all/*"), ("src/promo/*", "lib/promo-*"), ("other", "x")], "pattern string, replacement string")
    return imports.alias_targets(h.files.select(F.col("id").alias("import_id"), F.col("path").alias("specifier")), patterns)
