"""Projects the order-management tables onto the history schema.

The engine works on the canonical tables (commits, files, changes, ...). Where there is no
repository at hand, these views derive such tables from orders, parts and line items, so that every
classifier and join has something to decide. The texts hold for Spark and DuckDB alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels", "benchmark", "embeddings")

VIEWS: dict[str, str] = {
    "commits": """
SELECT o_orderkey AS id, md5(cast(o_orderkey AS string)) AS sha,
  CASE o_orderkey % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN c_name ELSE concat('  ', c_name) END AS author_name,
  CASE WHEN c_custkey % 7 = 0 THEN 'bot@noreply.example.org'
    ELSE concat('Dev', cast(cast(floor(c_custkey / 3) AS bigint) AS string), '@Example.org') END AS author_email,
  o_orderdate AS committed_at,
  CASE o_orderpriority
    WHEN '1-URGENT' THEN CASE o_orderkey % 4 WHEN 0 THEN concat('fix(core): overflow in total ', cast(o_orderkey AS string))
      WHEN 1 THEN concat('crash when parsing order ', cast(o_orderkey AS string))
      WHEN 2 THEN concat('fix(deps): bump parser ', cast(o_orderkey AS string))
      ELSE concat('Fix regression in report ', cast(o_orderkey AS string)) END
    WHEN '2-HIGH' THEN CASE o_orderkey % 3 WHEN 0 THEN concat('Revert "change ', cast(o_orderkey AS string), '"')
      WHEN 1 THEN concat('Rework export ', cast(o_orderkey AS string))
      ELSE concat('Handle broken header ', cast(o_orderkey AS string)) END
    WHEN '3-MEDIUM' THEN CASE o_orderkey % 4 WHEN 0 THEN 'Add temporary workaround for Node 14 until 2024-06'
      WHEN 1 THEN 'Add shim for Python 2.7' WHEN 2 THEN 'remove deprecated helper'
      ELSE 'legacy path for Go 1.18, expires on Q1 2030' END
    WHEN '5-LOW' THEN concat('fix typo in docs ', cast(o_orderkey AS string))
    ELSE concat('Update totals ', cast(o_orderkey AS string)) END AS subject,
  CASE o_orderkey % 7 WHEN 0 THEN concat('Fixes #', cast(o_orderkey % 500 + 1 AS string))
    WHEN 1 THEN concat('See GH-', cast(o_orderkey % 500 + 1 AS string), ' and acme/tools#7')
    WHEN 2 THEN concat('This reverts commit ', substr(md5(cast(o_orderkey - 1 AS string)), 1, 12), '.')
    WHEN 3 THEN concat('Relates to PROJ-', cast(o_orderkey % 90 + 1 AS string)) ELSE '' END AS body
FROM orders JOIN customer ON o_custkey = c_custkey""",
    # Lane 0 of 32 is the main branch; the others hold branches of four commits, of which two in three are merged.
    "commit_parents": """
SELECT id AS commit_id, CASE WHEN id % 32 <> 0 AND cast((id - id % 32) / 32 + id % 32 AS bigint) % 4 = 0 THEN id - id % 32 - 32 ELSE id - 32 END AS parent_id, 0 AS ordinal FROM commits WHERE id >= 32
UNION ALL SELECT m.id, b.id, cast(b.id % 32 AS int) FROM commits b JOIN commits m ON m.id = b.id - b.id % 32 + 32
WHERE b.id % 32 <> 0 AND b.id % 32 % 3 <> 0 AND cast((b.id - b.id % 32) / 32 + b.id % 32 AS bigint) % 4 = 3""",
    "files": """
SELECT p_partkey AS id,
  concat(CASE WHEN p_partkey % 13 = 0 THEN 'dist/' WHEN p_partkey % 17 = 0 THEN 'docs/' WHEN p_partkey % 11 = 0 THEN 'src/tests/' ELSE 'src/' END,
    lower(p_type), '/', replace(p_name, ' ', '_'), '_', cast(p_partkey AS string),
    CASE p_size % 10 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.go' WHEN 3 THEN '.json' WHEN 4 THEN '.test.ts'
      WHEN 5 THEN '.d.ts' WHEN 6 THEN '.rs' WHEN 7 THEN '.JAVA' WHEN 8 THEN '' ELSE '.ts' END) AS path,
  p_partkey % 19 = 0 AS deleted
FROM part""",
    "changes": """
SELECT l_orderkey * 10000000 + l_partkey AS id, l_orderkey AS commit_id, l_partkey AS file_id,
  CASE WHEN l_orderkey % 29 = 0 AND l_partkey > 1 THEN 'renamed' WHEN l_orderkey % 31 = 0 THEN 'deleted'
    WHEN l_orderkey % 5 = 0 THEN 'added' ELSE 'modified' END AS status,
  CASE WHEN l_orderkey % 29 = 0 AND l_partkey > 1 THEN l_partkey - 1 END AS previous_file_id,
  CASE WHEN l_orderkey % 58 = 0 THEN 0 WHEN (l_orderkey + l_partkey) % 23 = 0 THEN NULL ELSE cast(sum(l_quantity) AS bigint) END AS additions,
  CASE WHEN l_orderkey % 58 = 0 THEN 0 WHEN (l_orderkey + l_partkey) % 23 = 0 THEN NULL ELSE cast(floor(sum(l_quantity) / 4) AS bigint) END AS deletions
FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "dependencies": """
SELECT min(p_partkey) AS id, CASE p_partkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'go' WHEN 2 THEN 'cargo' ELSE 'pypi' END AS ecosystem, concat(replace(p_name, ' ', '-'), '-', cast(p_size AS string)) AS name
FROM part GROUP BY CASE p_partkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'go' WHEN 2 THEN 'cargo' ELSE 'pypi' END, concat(replace(p_name, ' ', '-'), '-', cast(p_size AS string))""",
    "evidence": """
SELECT id, concat(path, CASE WHEN id % 5 = 0 THEN '#runtime:node' WHEN id % 7 = 0 THEN '#runtime:python' ELSE concat('#L', cast(id % 90 AS string)) END) AS locator FROM files""",
    "dated_changes": """
SELECT c.id, c.commit_id, c.file_id, c.status, c.previous_file_id, c.additions, c.deletions, m.committed_at
FROM changes c JOIN commits m ON c.commit_id = m.id""",
    "imports": """
SELECT DISTINCT l_partkey AS source, (l_suppkey * 7 + l_partkey * 3) % 97 + l_partkey AS target, l_suppkey % 5 AS method
FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1""",
    "symbols": """
SELECT DISTINCT l_partkey * 100000 + l_suppkey AS id, l_partkey AS file_id,
  concat('fn_', cast(l_suppkey % 40 AS string)) AS name,
  concat(CASE WHEN l_suppkey % 3 = 0 THEN 'Cart.' ELSE '' END, 'fn_', cast(l_suppkey % 40 AS string)) AS qualified_name,
  CASE l_suppkey % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'variable' ELSE 'function' END AS kind,
  l_suppkey % 50 * 10 + 1 AS start_line, l_suppkey % 50 * 10 + 1 + (l_partkey + l_suppkey) % 25 AS end_line,
  l_suppkey % 9 <> 0 AS current
FROM lineitem""",
    "symbol_versions": """
SELECT l_partkey * 100000 + l_suppkey AS symbol_id, l_orderkey AS commit_id,
  md5(concat(cast(l_suppkey % 40 AS string), '/', cast(cast(max(l_quantity) AS bigint) % 7 AS string))) AS content_hash
FROM lineitem GROUP BY l_partkey, l_suppkey, l_orderkey""",
    # Eight orders stand for a squashed commit, so that symbols leave and appear in one; ten files share the parts.
    "lineage_sides": """
SELECT cast((l_orderkey - l_orderkey % 8) / 8 AS bigint) AS commit_id, l_partkey * 100000 + l_suppkey AS symbol_id, l_partkey % 10 AS file_id,
  CASE l_suppkey % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'method' ELSE 'function' END AS kind,
  concat(CASE WHEN l_suppkey % 3 = 0 THEN 'Cart.' ELSE '' END, 'fn_', cast(l_suppkey % 40 AS string)) AS qualified_name,
  md5(cast(cast(max(l_quantity) AS bigint) % 12 AS string)) AS shape, (l_partkey + l_suppkey) % 2 = 0 AS born
FROM lineitem WHERE l_suppkey % 6 <> 2 GROUP BY cast((l_orderkey - l_orderkey % 8) / 8 AS bigint), l_partkey, l_suppkey""",
    "discussions": """
SELECT o_orderkey AS commit_id, CASE WHEN o_orderkey % 3 = 0 THEN 'pull_request' ELSE 'issue' END AS type,
  CASE WHEN o_orderkey % 6 = 1 THEN concat('PROJ-', cast(o_orderkey % 90 + 1 AS string)) ELSE cast(o_orderkey % 500 + 1 AS string) END AS number,
  CASE WHEN o_orderkey % 6 = 1 THEN 'jira' ELSE 'github' END AS provider,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'bug' WHEN 'MACHINERY' THEN 'type: Regression' ELSE lower(c_mktsegment) END AS label,
  CASE WHEN o_orderkey % 3 = 0 THEN 'IMPLEMENTED_BY' WHEN o_orderkey % 6 = 1 THEN 'REFERENCES' WHEN o_orderkey % 2 = 0 THEN 'RESOLVED_BY' ELSE 'REFERENCES' END AS relation,
  CASE WHEN o_orderkey % 4 = 0 THEN 'FACT' WHEN o_orderkey % 4 = 1 THEN 'INFERRED' ELSE 'DERIVED' END AS level,
  CASE WHEN o_orderkey % 4 = 0 THEN 1.0 WHEN o_orderkey % 4 = 1 THEN 0.8 ELSE 0.9 END AS confidence
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 4 <> 3""",
    "calls": """
SELECT DISTINCT l_partkey AS file_id, l_suppkey % 50 * 10 + l_linenumber AS line, concat('fn_', cast((l_suppkey + 1) % 40 AS string)) AS callee
FROM lineitem WHERE l_linenumber <= 3""",
    # Call sites as a parser would give them: plain, on the own object, qualified, through a module, passed by name, of a stated type, on a local variable.
    "call_sites": """
SELECT file_id, line, callee, min(self_receiver) AS self_receiver, min(local_head) AS local_head, min(via) AS via, min(written) AS written FROM (
SELECT l_partkey AS file_id, l_suppkey % 50 * 10 + l_linenumber AS line,
  concat(CASE l_linenumber WHEN 2 THEN 'this.' WHEN 3 THEN 'Cart.' WHEN 4 THEN 'mod.' WHEN 6 THEN 'Cart.' WHEN 7 THEN 'obj.' ELSE '' END, 'fn_', cast((l_suppkey * 3 + l_orderkey) % 40 AS string)) AS callee,
  CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END AS self_receiver, CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS local_head,
  CASE WHEN l_linenumber = 5 THEN 'reference' ELSE 'call' END AS via, CASE WHEN l_linenumber = 6 THEN 'c.f' END AS written FROM lineitem) s GROUP BY file_id, line, callee""",
    "import_bindings": """
SELECT source AS file_id, 'mod' AS local_name, '*' AS imported, min(target) AS target, cast(0.9 AS double) AS confidence FROM imports GROUP BY source
UNION ALL SELECT source, concat('fn_', cast(target % 40 AS string)), concat('fn_', cast((target + 1) % 40 AS string)), min(target), max(CASE WHEN method = 0 THEN cast(1.0 AS double) ELSE cast(0.8 AS double) END) FROM imports GROUP BY source, target % 40, (target + 1) % 40""",
    "checked_calls": """
SELECT file_id AS from_file, line, file_id AS to_file, line + 7 AS to_line, substr(callee, 5) AS to_name FROM call_sites WHERE line % 10 = 4 AND callee LIKE 'mod.%'""",
    "line_coverage": """
SELECT p_partkey AS file_id, p_size + 4 AS n_found, p_size % 5 + 1 AS step, p_partkey % 4 <> 0 AS fresh FROM part WHERE p_partkey % 3 = 0""",
    "relations": """
SELECT 1000000000000000000 + id AS id, 'commit' AS source_type, commit_id AS source_id, 'MODIFIES' AS relation, 'file' AS target_type, file_id AS target_id, 1.0 AS confidence, 'FACT' AS level FROM changes
UNION ALL SELECT 2000000000000000000 + source * 1000000 + target, 'file', source, 'IMPORTS', 'file', target, 0.95, 'DERIVED' FROM (SELECT DISTINCT source, target FROM imports) i
UNION ALL SELECT 3000000000000000000 + id, 'file', file_id, 'CONTAINS', 'symbol', id, 1.0, 'FACT' FROM symbols
UNION ALL SELECT 4000000000000000000 + symbol_id, 'symbol', symbol_id, 'INTRODUCED_BY', 'commit', min(commit_id), CASE WHEN symbol_id % 5 = 0 THEN 0.8 ELSE 1.0 END, 'DERIVED' FROM symbol_versions WHERE symbol_id % 4 <> 0 GROUP BY symbol_id
UNION ALL SELECT 5000000000000000000 + id, 'symbol', id, 'COPIED_FROM', 'symbol', id - 100000, CASE WHEN id % 2 = 0 THEN 0.9 ELSE 0.6 END, CASE WHEN id % 2 = 0 THEN 'DERIVED' ELSE 'INFERRED' END FROM symbols WHERE id % 3 = 0
UNION ALL SELECT 6000000000000000000 + commit_id, type, commit_id % 500 + 1, relation, 'commit', commit_id, confidence, level FROM discussions WHERE relation <> 'REFERENCES'
UNION ALL SELECT 7000000000000000000 + commit_id, 'commit', commit_id, relation, type, commit_id % 500 + 1, confidence, level FROM discussions WHERE relation = 'REFERENCES'
UNION ALL SELECT 8000000000000000000 + id, 'symbol', id, 'CALLS', 'symbol', id + 200000, CASE WHEN id % 3 = 0 THEN 0.6 ELSE 0.95 END, CASE WHEN id % 3 = 0 THEN 'INFERRED' ELSE 'DERIVED' END FROM symbols WHERE id % 2 = 1""",
}


def needed(text: str) -> list[str]:
    """Names of the views that a SQL text uses, directly or through others, in order of definition."""
    found: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"[a-z_]+", todo.pop()))
        fresh = (words & set(VIEWS)) - found
        found |= fresh
        todo += [VIEWS[v] for v in fresh]
    return [v for v in VIEWS if v in found]


def with_views(text: str, ctes: str = "", recursive: bool = False) -> str:
    """DuckDB SQL: the views that are used, further CTEs, then the query."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in needed(ctes + " " + text)]
    parts += [ctes] if ctes else []
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else "") + text


class History:
    """The canonical tables over a folder of driver tables, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in BASE_TABLES:
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                used = {w for w in re.findall(r"[a-z_]+", VIEWS[name]) if w in VIEWS or w in BASE_TABLES} - {name}
                used = {w for w in used if re.search(rf"(?:FROM|JOIN)\s+{w}\b", VIEWS[name])}
                self._made[name] = self.spark.sql(re.sub(r"(FROM|JOIN)\s+([a-z_]+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], VIEWS[name]), **{w: getattr(self, w) for w in used})
            else:
                self._made[name] = self.base(name)
        return self._made[name]
