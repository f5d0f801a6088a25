"""Rust and ECMAScript imports over module trees that stand on parts and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import call_graph, resolvers
from ..sources.driver_tables import History
from .registry import register

# Spark and DuckDB read these alike. A brand is a crate or a package, a type a module, a part a file of it.
_PART = """SELECT p_partkey AS id, cast(replace(p_brand, 'Brand#', '') AS int) AS b, lower(p_type) AS t, concat(replace(p_name, ' ', '_'), '_', cast(p_size AS string)) AS w, p_partkey % 4 = 0 AS nested FROM part"""
RUST_FILES = f"""SELECT DISTINCT concat('crates/c', cast(b AS string), '/src/', t, '/', w, CASE WHEN nested THEN '/mod.rs' ELSE '.rs' END) AS path FROM ({_PART}) p
UNION SELECT concat('crates/c', cast(b AS string), '/src/', t, CASE (b + length(t)) % 3 WHEN 0 THEN '.rs' ELSE '/mod.rs' END) FROM ({_PART}) q WHERE (b + length(t)) % 3 <> 2
UNION SELECT concat('crates/c', cast(b AS string), CASE WHEN b % 5 = 0 THEN '/src/main.rs' ELSE '/src/lib.rs' END) FROM ({_PART}) r WHERE b % 11 <> 0"""
RUST_IMPORTS = f"""SELECT concat(path, ' ', specifier) AS import_id, * FROM (SELECT concat('crates/c', cast(p.b AS string), '/src/', p.t, '/', p.w, CASE WHEN p.nested THEN '/mod.rs' ELSE '.rs' END) AS path,
  'use' AS form, p.b, p.t, p.w, p.nested, CASE l_linenumber % 7 WHEN 0 THEN 'rand::Rng'
  WHEN 1 THEN concat('crate::', q.t, '::', q.w, '::Item') WHEN 2 THEN concat('super::', q.w, '::f') WHEN 3 THEN concat('super::super::', q.t) WHEN 4 THEN 'self::inner' WHEN 5 THEN 'std::io' ELSE 'serde_json::x' END AS specifier
FROM lineitem JOIN ({_PART}) p ON p.id = l_partkey JOIN ({_PART}) q ON q.id = CASE WHEN l_suppkey % 2 = 0 THEN l_partkey ELSE l_suppkey END) i"""


def spark_sql(h: History, text: str) -> DataFrame:
    for name in ("lineitem", "part"):
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return h.spark.sql(text, lineitem=h.lineitem, part=h.part) if "{lineitem}" in text else h.spark.sql(text, part=h.part)


@register("e15_rust_modules", """
SELECT import_id, CASE WHEN target IS NOT NULL THEN CASE WHEN first = 'serde_json' THEN 'dependency' ELSE 'files' END WHEN first = 'std' THEN 'builtin' ELSE 'unresolved' END AS kind, target FROM (
SELECT i.import_id, split_part(specifier, '::', 1) AS first, CASE
  WHEN specifier LIKE 'serde%' THEN CASE WHEN i.b % 2 = 0 THEN 'serde_json' END
  WHEN root.path IS NULL OR specifier LIKE 'std%' OR specifier LIKE 'rand%' THEN NULL
  WHEN specifier LIKE 'crate%' THEN CASE WHEN mt.path IS NULL THEN root.path ELSE coalesce(mw.path, mt.path) END
  WHEN specifier LIKE 'super::super%' THEN CASE WHEN mt.path IS NULL THEN root.path ELSE mt.path END
  WHEN ot.path IS NULL THEN NULL WHEN specifier LIKE 'super%' THEN coalesce(ow.path, ot.path) ELSE i.module END AS target
FROM (SELECT *, 'crates/c' || b || '/src/' AS src, CASE WHEN specifier LIKE 'crate%' OR specifier LIKE 'super::super%' THEN split_part(replace(replace(specifier, 'super::super::', ''), 'crate::', ''), '::', 1) END AS t2, split_part(replace(replace(specifier, 'crate::', ''), 'super::', ''), '::', CASE WHEN specifier LIKE 'crate%' THEN 2 ELSE 1 END) AS w2 FROM imp) i
LEFT JOIN tree root ON root.dir = src AND root.name = ''
LEFT JOIN tree mt ON mt.dir = src AND mt.name = t2 LEFT JOIN tree mw ON mw.dir = src || t2 || '/' AND mw.name = w2
LEFT JOIN tree ot ON ot.dir = src AND ot.name = i.t LEFT JOIN tree ow ON ow.dir = src || i.t || '/' AND ow.name = w2) x""", f"""fl AS ({RUST_FILES}), raw AS ({RUST_IMPORTS}),
tree AS (SELECT dir, name, arg_min(path, place) AS path FROM (
  SELECT regexp_extract(path, '^(.*/)[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)\\.rs$', 1) AS name, path, 0 AS place FROM fl WHERE path NOT LIKE '%/mod.rs' AND path NOT LIKE '%/src/lib.rs' AND path NOT LIKE '%/src/main.rs'
  UNION ALL SELECT regexp_extract(path, '^(.*/)[^/]*/mod\\.rs$', 1), regexp_extract(path, '([^/]*)/mod\\.rs$', 1), path, 1 FROM fl WHERE path LIKE '%/mod.rs'
  UNION ALL SELECT regexp_extract(path, '^(.*/src/)', 1), '', path, 0 FROM fl WHERE path LIKE '%/src/lib.rs' OR path LIKE '%/src/main.rs') m GROUP BY dir, name),
imp AS (SELECT raw.*, o.path AS module FROM (SELECT import_id, any_value(specifier) AS specifier, any_value(b) AS b, any_value(t) AS t, any_value(w) AS w FROM raw GROUP BY import_id) raw JOIN tree o ON o.dir = 'crates/c' || b || '/src/' || t || '/' AND o.name = w)""")
def rust_modules(h: History) -> DataFrame:
    files = spark_sql(h, RUST_FILES)
    crates = spark_sql(h, f"SELECT DISTINCT concat('crates/c', cast(b AS string), '/Cargo.toml') AS path, CASE WHEN b % 2 = 0 THEN array('serde_json', 'anyhow') ELSE array('anyhow') END AS dependencies FROM ({_PART}) p")
    return resolvers.rust_imports(spark_sql(h, RUST_IMPORTS).select("import_id", "path", "form", "specifier").distinct(), files, crates).select("import_id", "kind", "target")


ES_FILES = f"""SELECT DISTINCT concat('apps/b', cast(b AS string), '/src/', t, '/', w, CASE WHEN nested THEN '/index.ts' ELSE '.tsx' END) AS path FROM ({_PART}) p
UNION SELECT concat('apps/b', cast(b AS string), '/tsconfig.json') FROM ({_PART}) q WHERE b % 4 <> 3
UNION SELECT concat('base/b', cast(b % 3 AS string), '.json') FROM ({_PART}) r UNION SELECT concat('apps/b', cast(b AS string), '/package.json') FROM ({_PART}) s"""
ES_IMPORTS = f"""SELECT concat(path, ' ', specifier) AS import_id, * FROM (SELECT concat('apps/b', cast(p.b AS string), '/src/', p.t, '/', p.w, CASE WHEN p.nested THEN '/index.ts' ELSE '.tsx' END) AS path, p.b, q.b AS b2, q.t AS t2, q.w AS w2,
  CASE WHEN p.nested THEN 1 ELSE 0 END AS up, p.t, CASE l_linenumber % 7 WHEN 0 THEN 'left-pad' WHEN 1 THEN concat('@/', q.t, '/', q.w) WHEN 2 THEN concat(CASE WHEN p.nested THEN '../' ELSE './' END, q.w, '.js')
  WHEN 3 THEN concat('@shop/b', cast(q.b AS string)) WHEN 4 THEN concat(q.t, '/', q.w) WHEN 5 THEN 'events' ELSE 'react/jsx' END AS specifier
FROM lineitem JOIN ({_PART}) p ON p.id = l_partkey JOIN ({_PART}) q ON q.id = CASE WHEN l_suppkey % 2 = 0 THEN l_partkey ELSE l_suppkey END) i"""


@register("e12_ecmascript_imports", """
SELECT import_id, CASE WHEN specifier = 'events' THEN 'builtin' WHEN specifier LIKE 'react%' AND b % 2 = 0 THEN 'dependency' WHEN target IS NULL THEN 'unresolved' ELSE 'files' END AS kind,
  CASE WHEN specifier LIKE 'react%' AND b % 2 = 0 THEN 'react' ELSE target END AS target, method FROM (
SELECT i.*, CASE WHEN specifier LIKE '@/%' THEN CASE WHEN b % 3 = 0 AND b % 4 <> 3 THEN alias.path END WHEN specifier LIKE '.%' THEN sib.path WHEN specifier LIKE '@shop%' THEN entry.path WHEN specifier = t2 || '/' || w2 AND b % 3 = 1 AND b % 4 <> 3 THEN alias.path END AS target,
  CASE WHEN specifier = 'events' THEN NULL WHEN specifier LIKE 'react%' AND b % 2 = 0 THEN 'declared-package' WHEN specifier LIKE '@/%' AND b % 3 = 0 AND b % 4 <> 3 AND alias.path IS NOT NULL THEN 'tsconfig-paths:base/b0.json#@/*' WHEN specifier LIKE '.%' AND sib.path IS NOT NULL THEN 'relative-path'
    WHEN specifier LIKE '@shop%' AND entry.path IS NOT NULL THEN 'workspace-package-entry' WHEN specifier = t2 || '/' || w2 AND b % 3 = 1 AND b % 4 <> 3 AND alias.path IS NOT NULL THEN 'tsconfig-base-url:base/b1.json' END AS method
FROM imp i LEFT JOIN stems alias ON alias.stem = CASE b % 3 WHEN 0 THEN 'apps/b3/src/' WHEN 1 THEN 'apps/b1/src/' END || t2 || '/' || w2
LEFT JOIN sibs sib ON sib.stem = 'apps/b' || b || '/src/' || t || '/' || w2
LEFT JOIN (SELECT b AS own, min(path) AS path FROM entries GROUP BY b) entry ON entry.own = i.b2) x""", f"""fl AS ({ES_FILES}), imp AS (SELECT import_id, any_value(specifier) AS specifier, any_value(b) AS b, any_value(t) AS t, any_value(b2) AS b2, any_value(t2) AS t2, any_value(w2) AS w2 FROM ({ES_IMPORTS}) r GROUP BY import_id),
stems AS (SELECT stem, arg_min(path, place) AS path FROM (SELECT replace(path, '.tsx', '') AS stem, path, 0 AS place FROM fl WHERE path LIKE '%.tsx' UNION ALL SELECT replace(path, '/index.ts', ''), path, 1 FROM fl WHERE path LIKE '%/index.ts') s GROUP BY stem),
sibs AS (SELECT replace(path, '.tsx', '') AS stem, path FROM fl WHERE path LIKE '%.tsx'),
entries AS (SELECT b, 'apps/b' || b || '/src/economy/hot_gear_37.tsx' AS path FROM (SELECT DISTINCT b2 AS b FROM imp) d WHERE 'apps/b' || b || '/src/economy/hot_gear_37.tsx' IN (SELECT path FROM fl))""")
def ecmascript_imports(h: History) -> DataFrame:
    """Every third package takes its patterns from one base file, the next its baseUrl from another; the last kind has neither."""
    files = spark_sql(h, ES_FILES)
    packages = f"""SELECT concat('apps/b', cast(b AS string), '/package.json') AS path, concat('@shop/b', cast(b AS string)) AS name, map('.', array('./dist/index.js', './src/economy/hot_gear_37.tsx')) AS entries,
  CASE WHEN b % 2 = 0 THEN array('react', 'vite') ELSE array('vite') END AS dependencies FROM (SELECT DISTINCT b FROM ({_PART}) p) d"""
    configs = resolvers.read_configs(_contents(h))
    return resolvers.ecmascript_imports(spark_sql(h, ES_IMPORTS).select("import_id", "path", "specifier").distinct(), files, configs, spark_sql(h, packages)).select("import_id", "kind", "target", "method")


def _contents(h: History) -> DataFrame:
    """Configuration files of the packages (path, content)."""
    b = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    brands = h.part.select(b.alias("b")).distinct()
    kind = (F.col("b") % 3).cast("string")
    own = brands.where("b % 4 <> 3").select(F.concat(F.lit("apps/b"), F.col("b").cast("string"), F.lit("/tsconfig.json")).alias("path"), F.concat(F.lit('{"extends": "../../base/b'), kind, F.lit('", /* see base */ }')).alias("content"))
    text = F.when(F.col("b") % 3 == 0, '{"compilerOptions": {"paths": {"@/*": ["../apps/b3/src/*"]}}}').when(F.col("b") % 3 == 1, '{"compilerOptions": {"baseUrl": "../apps/b1/src"}}').otherwise("{}")
    return own.unionByName(brands.select(F.concat(F.lit("base/b"), kind, F.lit(".json")).alias("path"), text.alias("content")).distinct())


_INNER = "SELECT {keys}, arg_min(s.id, (s.end_line - s.start_line, s.id)) AS caller FROM {sites} c JOIN cur s ON s.file_id = c.{file} AND c.{line} BETWEEN s.start_line AND s.end_line{more} GROUP BY {keys}"
CALL_CTES = f"""cur AS (SELECT * FROM symbols WHERE current),
unique_in AS (SELECT file_id, qualified_name, min(id) AS id FROM cur GROUP BY 1, 2 HAVING count(*) = 1),
unique_all AS (SELECT qualified_name, min(id) AS id FROM cur GROUP BY 1 HAVING count(*) = 1),
callers AS ({_INNER.format(keys="c.file_id, c.line", sites="(SELECT DISTINCT file_id, line FROM call_sites)", file="file_id", line="line", more="")}),
site AS (SELECT c.*, k.caller, split_part(callee, '.', 1) AS head, CASE WHEN contains(callee, '.') THEN split_part(callee, '.', 2) END AS rest FROM call_sites c LEFT JOIN callers k USING (file_id, line)
  WHERE (c.file_id, c.line) NOT IN (SELECT (from_file, line) FROM checked_calls)),
met AS (SELECT s.*, b.imported, b.target AS to_file, b.confidence AS sure FROM site s LEFT JOIN import_bindings b ON b.file_id = s.file_id AND b.local_name = s.head AND s.self_receiver = 0 AND s.local_head = 0),
reading AS (SELECT m.*, u.id AS target, 'DERIVED' AS level, 1.0::DOUBLE AS c, 'same-class' AS method FROM met m JOIN cur k ON k.id = m.caller JOIN unique_in u ON u.file_id = m.file_id AND u.qualified_name = split_part(k.qualified_name, '.', 1) || '.' || m.rest WHERE m.self_receiver = 1 AND contains(k.qualified_name, '.')
  UNION ALL SELECT m.*, u.id, 'DERIVED', least(0.95, sure), 'import-binding' FROM met m JOIN unique_in u ON u.file_id = m.to_file AND u.qualified_name = CASE WHEN m.imported = '*' THEN m.rest WHEN m.rest IS NULL THEN m.imported ELSE m.imported || '.' || m.rest END WHERE m.imported IS NOT NULL
  UNION ALL SELECT m.*, u.id, 'DERIVED', 1.0, 'same-file' FROM met m JOIN unique_in u ON u.file_id = m.file_id AND u.qualified_name = m.callee WHERE m.imported IS NULL AND m.self_receiver = 0 AND m.local_head = 0
  UNION ALL SELECT m.*, a.id, 'INFERRED', 0.6, 'qualified-name' FROM met m JOIN unique_all a ON a.qualified_name = m.callee LEFT JOIN unique_in u ON u.file_id = m.file_id AND u.qualified_name = m.callee AND m.local_head = 0 WHERE m.imported IS NULL AND m.self_receiver = 0 AND m.rest IS NOT NULL AND u.id IS NULL),
weighed AS (SELECT r.file_id, r.line, r.callee, r.caller, r.target, CASE WHEN via = 'reference' THEN 'INFERRED' ELSE level END AS level, CASE WHEN via = 'reference' THEN least(0.8, c * f) ELSE c * f END AS confidence, method || CASE WHEN written IS NULL THEN '' ELSE '+stated-type' END || CASE WHEN via = 'reference' THEN '+passed-as-value' ELSE '' END AS method
  FROM (SELECT *, CASE WHEN written IS NULL THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS f FROM reading) r JOIN cur t ON t.id = r.target WHERE via <> 'reference' OR t.kind IN ('function', 'method')),
aims AS ({_INNER.format(keys="c.to_file, c.to_line, c.to_name", sites="(SELECT DISTINCT to_file, to_line, to_name FROM checked_calls)", file="to_file", line="to_line", more=" AND s.name = c.to_name")}),
every AS (SELECT * FROM weighed UNION ALL SELECT c.from_file, c.line, c.to_name, k.caller, a.caller, 'DERIVED', 1.0, 'typescript-checker' FROM (SELECT DISTINCT * FROM checked_calls) c JOIN aims a USING (to_file, to_line, to_name) LEFT JOIN callers k ON k.file_id = c.from_file AND k.line = c.line),
placed AS (SELECT *, CASE WHEN caller IS NULL THEN 'file' ELSE 'symbol' END AS source_type, coalesce(caller, file_id) AS source_id FROM every WHERE caller IS NULL OR caller <> target)"""


@register("e17_call_edges", "SELECT source_type, source_id, target, level, floor(confidence * 1000000 + 0.5) / 1000000 AS confidence, method, line, callee FROM (SELECT *, row_number() OVER (PARTITION BY source_type, source_id, target ORDER BY CASE WHEN method = 'typescript-checker' THEN 0 ELSE 1 END, confidence DESC, file_id, line, callee) AS n FROM placed) p WHERE n = 1", CALL_CTES)
def call_edges(h: History) -> DataFrame:
    """All readings of a call: own class, bound names, the file, qualified names, stated types, functions passed, checked calls."""
    calls = h.call_sites.withColumns({"self_receiver": F.col("self_receiver") == 1, "local_head": F.col("local_head") == 1})
    bindings = h.import_bindings.withColumn("targets", F.array("target"))
    found = call_graph.call_edges(calls, h.symbols.where("current"), bindings, h.checked_calls)
    return found.withColumn("confidence", F.floor(F.col("confidence") * 1000000 + 0.5) / 1000000)


SUFFIX_FILES = f"""SELECT DISTINCT concat('m', CASE WHEN t = 'economy' THEN '0' ELSE cast(b % 3 AS string) END, '/src/com/', t, '/', w, '.java') AS path FROM ({_PART}) p
UNION SELECT concat(CASE WHEN b % 2 = 0 THEN 'lib/' ELSE 'app/' END, t, '/', w, '.rb') FROM ({_PART}) q UNION SELECT concat('src', cast(b % 2 AS string), '/', t, '/', w, '.php') FROM ({_PART}) r"""
_TARGET = f"SELECT DISTINCT l_linenumber AS k, p.t, p.w FROM lineitem JOIN ({_PART}) p ON p.id = CASE WHEN l_suppkey % 2 = 0 THEN l_partkey ELSE l_suppkey END"
SUFFIX_IMPORTS = f"""SELECT DISTINCT concat(language, ' ', specifier) AS import_id, 'x/y' AS path, language, 'use' AS form, specifier, k, t, CASE WHEN k = 3 THEN '' ELSE w END AS w FROM (
SELECT k, t, w, CASE WHEN k <= 3 THEN 'java' WHEN k <= 5 THEN 'ruby' ELSE 'php' END AS language,
  CASE k WHEN 1 THEN concat('com.', t, '.', w) WHEN 2 THEN concat('com.', t, '.', w, '.Inner') WHEN 3 THEN concat('com.', t, '.*') WHEN 4 THEN concat(t, '/', w) WHEN 5 THEN concat(t, '/', w, '.rb') ELSE concat('App', chr(92), t, chr(92), w) END AS specifier FROM ({_TARGET}) x WHERE k <= 6) i"""


@register("e16_suffix_imports", """
SELECT import_id, CASE WHEN target IS NULL THEN 'unresolved' ELSE 'files' END AS kind, target FROM (
SELECT i.import_id, CASE k WHEN 1 THEN j.one WHEN 2 THEN j.one WHEN 3 THEN d.held WHEN 6 THEN h.one ELSE coalesce(l.path, CASE WHEN r.n = 1 THEN r.path END) END AS target FROM imp i
LEFT JOIN (SELECT t, w, CASE WHEN count(*) = 1 THEN min(path) END AS one FROM fl WHERE path LIKE '%.java' GROUP BY 1, 2) j ON j.t = i.t AND j.w = i.w
LEFT JOIN (SELECT t, CASE WHEN count(DISTINCT root) = 1 THEN string_agg(path, ';' ORDER BY path) END AS held FROM fl WHERE path LIKE '%.java' GROUP BY t) d ON d.t = i.t
LEFT JOIN (SELECT t, w, CASE WHEN count(*) = 1 THEN min(path) END AS one FROM fl WHERE path LIKE '%.php' GROUP BY 1, 2) h ON h.t = i.t AND h.w = i.w
LEFT JOIN (SELECT t, w, path FROM fl WHERE path LIKE 'lib/%') l ON l.t = i.t AND l.w = i.w
LEFT JOIN (SELECT t, w, count(*) AS n, min(path) AS path FROM fl WHERE path LIKE '%.rb' GROUP BY 1, 2) r ON r.t = i.t AND r.w = i.w) x""", f"""raw AS ({SUFFIX_FILES}),
fl AS (SELECT path, split_part(path, '/', 1) AS root, string_split(path, '/')[-2] AS t, regexp_replace(string_split(path, '/')[-1], '\\.[a-z]+$', '') AS w FROM raw), imp AS ({SUFFIX_IMPORTS})""")
def suffix_imports(h: History) -> DataFrame:
    """Java classes, inner classes and packages, Ruby and PHP files by the ends of their paths."""
    rows = spark_sql(h, SUFFIX_IMPORTS).select("import_id", "path", "language", "form", "specifier").distinct()
    return resolvers.suffix_imports(rows, spark_sql(h, SUFFIX_FILES)).select("import_id", "kind", F.array_join("targets", ";").alias("target"))
