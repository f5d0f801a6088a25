"""Projections, predicates, joins, unions and point reads over the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import activity, search
from ..sources.driver_tables import History
from .registry import register

TEST_SQL = "(regexp_matches(path, '(^|/)(tests?|__tests__|spec)/|[._-](test|spec)\\.[a-z]+$|(^|/)test_[^/]+\\.py$|_test\\.go$', 'i') OR regexp_matches(path, '[a-z0-9](Tests?|Spec)\\.(java|kt|cs|php)$'))"
GENERATED_SQL = "regexp_matches(path, '(^|/)(pnpm-lock\\.yaml|package-lock\\.json|npm-shrinkwrap\\.json|yarn\\.lock|bun\\.lockb?|Cargo\\.lock|go\\.sum|poetry\\.lock|uv\\.lock|Pipfile\\.lock|Gemfile\\.lock|composer\\.lock)$|(^|/)(dist|build|out|coverage|vendor|node_modules|__snapshots__)/|\\.min\\.(js|css)$|\\.(snap|map)$|_snapshot\\.json$')"
ILLUSTRATIVE_SQL = "regexp_matches(path, '(^|/)(examples?|samples?|demos?|docs?|fixtures?|benchmarks?|__mocks__)/', 'i')"
DECLARATION_SQL = "regexp_matches(path, '\\.d\\.[cm]?ts$')"
EXTENSION_SQL = "lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1))"
LANGUAGE_SQL = f"CASE {EXTENSION_SQL} WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'json' END"
CODE_SQL = f"coalesce(({LANGUAGE_SQL}) NOT IN ('markdown', 'json', 'yaml', 'toml'), false)"


@register("p1_file_projection", "SELECT id, path, deleted FROM files")
def file_projection(h: History) -> DataFrame:
    return h.files.select("id", "path", "deleted")


@register("p2_commits_by_sha_prefix", "SELECT id, sha FROM commits WHERE sha LIKE 'ab%' ORDER BY id LIMIT 20")
def by_sha_prefix(h: History) -> DataFrame:
    return search.commits_by_sha_prefix(h.commits, "AB").select("id", "sha")


@register("p3_files_by_path", "SELECT f.id, f.path FROM files f WHERE path IN (SELECT path FROM files WHERE id % 100 = 7)")
def by_path(h: History) -> DataFrame:
    wanted = h.files.where("id % 100 = 7").select("path")
    return h.files.join(wanted, "path", "left_semi").select("id", "path")


@register("p4_symbols_by_name", "SELECT id, qualified_name, current FROM symbols WHERE name = 'fn_7' OR qualified_name = 'fn_7' ORDER BY current DESC, id LIMIT 20")
def by_name(h: History) -> DataFrame:
    return search.symbols_by_name(h.symbols, "fn_7").select("id", "qualified_name", "current")


@register("p5_discussions_by_number", "SELECT type, number, count(*) AS n FROM (SELECT * FROM discussions WHERE type = 'issue' UNION ALL SELECT * FROM discussions WHERE type = 'pull_request') d WHERE number = '42' GROUP BY type, number")
def by_number(h: History) -> DataFrame:
    d = h.discussions.where("number = '42'")
    both = d.where("type = 'issue'").unionByName(d.where("type = 'pull_request'"))
    return both.groupBy("type", "number").agg(F.count("*").alias("n"))


@register("p7_search_files", "SELECT id, path, deleted FROM files WHERE contains(lower(path), 'widget') ORDER BY deleted, path LIMIT 50")
def search_files(h: History) -> DataFrame:
    return search.search_files(h.files, "WIDGET", 50).select("id", "path", "deleted")


@register("p8_recent_commits", "SELECT id, strftime(committed_at, '%Y-%m-%d') AS day FROM commits ORDER BY committed_at DESC, id DESC LIMIT 30")
def recent(h: History) -> DataFrame:
    return search.recent_commits(h.commits, 30).select("id", F.date_format("committed_at", "yyyy-MM-dd").alias("day"))


@register("p9_commits_mentioning", "SELECT id, subject FROM commits WHERE contains(lower(subject), 'shim') OR contains(lower(body), 'shim') OR contains(lower(subject), 'gh-42') OR contains(lower(body), 'gh-42') ORDER BY committed_at DESC, id DESC LIMIT 40")
def mentioning(h: History) -> DataFrame:
    return search.commits_mentioning(h.commits, ["Shim", "gh-42"], 40).select("id", "subject")


@register("p10_path_classes", f"SELECT id, path, {TEST_SQL} AS is_test, {GENERATED_SQL} AS is_generated, {CODE_SQL} AS is_code, {ILLUSTRATIVE_SQL} AS is_illustrative, {DECLARATION_SQL} AS is_declaration FROM files")
def path_classes(h: History) -> DataFrame:
    p = F.col("path")
    return h.files.select("id", "path", paths.is_test(p).alias("is_test"), paths.is_generated(p).alias("is_generated"), F.coalesce(paths.is_code(p), F.lit(False)).alias("is_code"), paths.is_illustrative(p).alias("is_illustrative"), paths.is_declaration(p).alias("is_declaration"))


@register("p14_language", f"SELECT {LANGUAGE_SQL} AS language, count(*) AS n FROM files GROUP BY 1")
def languages(h: History) -> DataFrame:
    return h.files.groupBy(paths.language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@register("p15_grammar", f"SELECT id, CASE {EXTENSION_SQL} WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' END AS grammar FROM files")
def grammars(h: History) -> DataFrame:
    return h.files.select("id", paths.grammar(F.col("path")).alias("grammar"))


@register("p16_scope", "SELECT id, path FROM files WHERE path = 'src/promo' OR path LIKE 'src/promo/%'")
def scope(h: History) -> DataFrame:
    return h.files.where(paths.in_scope(F.col("path"), "src/promo/")).select("id", "path")


@register("p17_pure_renames", "SELECT id, coalesce(additions, 0) + coalesce(deletions, 0) = 0 AS pure, coalesce(additions, 1) + coalesce(deletions, 1) = 0 AS pure_for_why FROM changes WHERE status = 'renamed'")
def pure_renames(h: History) -> DataFrame:
    return h.changes.where("status = 'renamed'").select("id", activity.is_pure_rename().alias("pure"), activity.is_pure_rename(1).alias("pure_for_why"))


@register("p18_binding_reach", "SELECT s.id, b.imported, b.imported IN ('*', 'default') OR b.imported = s.qualified_name OR starts_with(s.qualified_name, b.imported || '.') OR starts_with(b.imported, s.qualified_name || '.') OR NOT list_contains(d.names, b.imported) AS reaches FROM symbols s JOIN (SELECT file_id, list(DISTINCT qualified_name) AS names FROM symbols GROUP BY file_id) d USING (file_id) JOIN (SELECT unnest(['*', 'Cart', 'fn_3', 'fn_3.x', 'other']) AS imported) b ON true")
def binding_reach(h: History) -> DataFrame:
    defined = h.symbols.groupBy("file_id").agg(F.collect_set("qualified_name").alias("names"))
    names = F.array(*map(F.lit, ["*", "Cart", "fn_3", "fn_3.x", "other"]))
    rows = h.symbols.join(defined, "file_id").withColumn("imported", F.explode(names))
    return rows.select("id", "imported", search.binding_may_reach(F.col("imported"), F.col("qualified_name"), F.col("names")).alias("reaches"))


@register("p19_pending_changes", "SELECT c.id, c.commit_id, p.id AS parent_id FROM dated_changes c LEFT JOIN commits p ON p.id = c.commit_id - 1 WHERE c.status IN ('added', 'modified') AND c.additions IS NOT NULL ORDER BY c.committed_at, c.commit_id, c.id LIMIT 200")
def pending(h: History) -> DataFrame:
    """The work queue: unindexed changes in commit order with their first parent, one batch."""
    todo = h.dated_changes.where("status IN ('added', 'modified') AND additions IS NOT NULL").orderBy("committed_at", "commit_id", "id").limit(200)
    parents = h.commits.select((F.col("id") + 1).alias("commit_id"), F.col("id").alias("parent_id"))
    return todo.join(parents, "commit_id", "left").select("id", "commit_id", "parent_id")


@register("p20_pending_details", "SELECT commit_id FROM discussions WHERE type = 'pull_request' AND (commit_id % 5 = 0 OR commit_id % 11 < commit_id % 7)")
def pending_details(h: History) -> DataFrame:
    synced, updated = F.when(F.col("commit_id") % 5 != 0, F.col("commit_id") % 11), F.col("commit_id") % 7
    return search.stale(h.discussions.where("type = 'pull_request'"), synced, updated).select("commit_id")


@register("j1_changes_commits", "SELECT c.id, m.sha, strftime(m.committed_at, '%Y-%m-%d') AS day FROM changes c JOIN commits m ON c.commit_id = m.id")
def changes_commits(h: History) -> DataFrame:
    return h.changes.join(h.commits.select(F.col("id").alias("commit_id"), "sha", "committed_at"), "commit_id").select("id", "sha", F.date_format("committed_at", "yyyy-MM-dd").alias("day"))


@register("j2_symbols_changed_in", "SELECT DISTINCT v.commit_id, s.id AS symbol_id, s.qualified_name FROM symbol_versions v JOIN symbols s ON v.symbol_id = s.id WHERE v.commit_id IN (SELECT id FROM commits WHERE subject LIKE 'Revert%')")
def symbols_changed_in(h: History) -> DataFrame:
    wanted = h.commits.where(F.col("subject").startswith("Revert")).select(F.col("id").alias("commit_id"))
    return search.symbols_changed_in(h.symbol_versions, h.symbols, wanted)


@register("j3_current_symbols", "SELECT s.id, s.qualified_name, f.path FROM symbols s JOIN files f ON s.file_id = f.id WHERE s.current AND NOT f.deleted")
def current_symbols(h: History) -> DataFrame:
    live = h.files.where("NOT deleted").select(F.col("id").alias("file_id"), "path")
    return h.symbols.where("current").join(live, "file_id").select("id", "qualified_name", "path")


@register("j4_commit_discussions", "SELECT CASE WHEN source_type = 'commit' THEN source_id ELSE target_id END AS commit_id, CASE WHEN source_type = 'commit' THEN target_type ELSE source_type END AS type, CASE WHEN source_type = 'commit' THEN target_id ELSE source_id END AS number, relation, level FROM relations WHERE relation IN ('RESOLVED_BY', 'IMPLEMENTED_BY', 'REFERENCES')")
def commit_discussions(h: History) -> DataFrame:
    return search.commit_discussions(h.relations).select("commit_id", "type", "number", "relation", "level")


@register("j6_coverage_join", "SELECT f.id, f.path, v.n_found, v.fresh FROM files f LEFT JOIN line_coverage v ON f.id = v.file_id WHERE NOT f.deleted")
def coverage_join(h: History) -> DataFrame:
    return h.files.where("NOT deleted").join(h.line_coverage.withColumnRenamed("file_id", "id"), "id", "left").select("id", "path", "n_found", "fresh")


@register("j7_identical_texts", "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) d WHERE doc_id <> first_id")
def identical_texts(h: History) -> DataFrame:
    return search.identical_copies(h.documents.select("doc_id", "text"))


@register("j7_identical_symbols", """
SELECT symbol_id, commit_id, copied_from FROM (
SELECT a.symbol_id, a.commit_id, b.symbol_id AS copied_from, row_number() OVER (PARTITION BY a.symbol_id, a.commit_id ORDER BY b.commit_id DESC, b.symbol_id DESC) AS n
FROM (SELECT v.*, s.file_id, s.name, s.kind FROM symbol_versions v JOIN symbols s ON v.symbol_id = s.id WHERE s.kind <> 'variable') a
JOIN (SELECT v.*, s.file_id, s.name, s.kind FROM symbol_versions v JOIN symbols s ON v.symbol_id = s.id WHERE s.kind <> 'variable') b
  ON a.content_hash = b.content_hash AND a.name = b.name AND a.kind = b.kind AND a.file_id <> b.file_id
  AND (b.commit_id < a.commit_id OR b.commit_id = a.commit_id AND b.symbol_id < a.symbol_id)) x WHERE n = 1""")
def identical_symbols(h: History) -> DataFrame:
    return search.identical_symbols(h.symbol_versions, h.symbols.where("kind <> 'variable'"))


@register("j10_cited_evidence", "SELECT DISTINCT e AS evidence_id FROM (SELECT unnest([commit_id, commit_id + 1]) AS e FROM discussions) x WHERE e IN (SELECT id FROM commits)")
def cited(h: History) -> DataFrame:
    ids = h.discussions.select(F.explode(F.array("commit_id", F.col("commit_id") + 1)).alias("evidence_id")).distinct()
    return ids.join(h.commits.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi")


@register("j11_uncited_evidence", "SELECT id FROM commits WHERE id NOT IN (SELECT commit_id FROM discussions) AND id NOT IN (SELECT commit_id FROM changes WHERE status = 'renamed') AND id NOT IN (SELECT commit_id FROM symbol_versions WHERE symbol_id % 7 = 0)")
def uncited(h: History) -> DataFrame:
    uses = [h.discussions, h.changes.where("status = 'renamed'"), h.symbol_versions.where("symbol_id % 7 = 0")]
    return search.unused(h.commits.select("id"), [u.select(F.col("commit_id").alias("id")) for u in uses])


@register("j12_files_touched", "SELECT id FROM files WHERE id IN (SELECT file_id FROM changes WHERE commit_id % 40 = 0) OR id IN (SELECT previous_file_id FROM changes WHERE commit_id % 40 = 0) OR id IN (SELECT file_id FROM symbols WHERE id IN (SELECT symbol_id FROM symbol_versions WHERE commit_id % 40 = 0))")
def files_touched(h: History) -> DataFrame:
    pruned = h.changes.where("commit_id % 40 = 0")
    by_symbol = h.symbols.join(h.symbol_versions.where("commit_id % 40 = 0").select(F.col("symbol_id").alias("id")), "id", "left_semi")
    touched = pruned.select(F.col("file_id").alias("id")).unionByName(pruned.select(F.col("previous_file_id").alias("id"))).unionByName(by_symbol.select(F.col("file_id").alias("id"))).distinct()
    return h.files.join(touched, "id", "left_semi").select("id")


@register("j13_innermost_symbol", """
SELECT c.file_id, c.line, c.callee, arg_min(s.id, (s.end_line - s.start_line) * 1000000000000000 + s.id) AS caller_id
FROM calls c JOIN symbols s ON c.file_id = s.file_id AND c.line BETWEEN s.start_line AND s.end_line AND s.current GROUP BY 1, 2, 3""")
def innermost(h: History) -> DataFrame:
    return search.innermost(h.calls, h.symbols.where("current"))


@register("j14_covered_lines", """
SELECT s.id, len(list_filter(range(1, v.n_found * 3, 3), lambda x: x BETWEEN s.start_line AND s.end_line)) AS found
FROM symbols s JOIN line_coverage v ON s.file_id = v.file_id""")
def covered_lines(h: History) -> DataFrame:
    lines = h.line_coverage.select("file_id", F.sequence(F.lit(1), F.col("n_found") * 3 - 1, F.lit(3)).alias("lines"))
    rows = h.symbols.join(lines, "file_id")
    return rows.select("id", F.expr("cast(size(filter(lines, x -> x BETWEEN start_line AND end_line)) AS bigint)").alias("found"))


@register("j16_import_candidates", """
SELECT p.page_id, p.link, arg_min(f.page_id, c.place * 1000000000 + f.page_id) AS target
FROM (SELECT DISTINCT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS link FROM pages) q) p
JOIN (SELECT 0 AS place, '' AS tail UNION ALL SELECT 1, '/' UNION ALL SELECT 2, '.') c ON true
JOIN (SELECT page_id, regexp_extract(html, '<nav><ul><li><a href="/([^"]+)"', 1) AS path FROM pages) f ON f.path = p.link || c.tail GROUP BY 1, 2""")
def import_candidates(h: History) -> DataFrame:
    """Links of pages resolved like imports: candidate paths in order, the first that exists wins."""
    links = h.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("link")).distinct()
    known = h.pages.select(F.col("page_id").alias("target"), F.regexp_extract("html", '<nav><ul><li><a href="/([^"]+)"', 1).alias("path"))
    tried = links.select("page_id", "link", F.posexplode(F.array("link", F.concat("link", F.lit("/")), F.concat("link", F.lit(".")))).alias("place", "path"))
    return search.first_existing(tried, known, ["page_id", "link"])


@register("j17_unique_suffix", """
SELECT name AS suffix, min(id) AS file_id FROM (SELECT id, split_part(path, '/', -1) AS name FROM files WHERE NOT deleted
UNION ALL SELECT id, split_part(path, '/', -2) || '/' || split_part(path, '/', -1) FROM files WHERE NOT deleted AND path LIKE '%/%') x GROUP BY name HAVING count(*) = 1""")
def unique_suffix(h: History) -> DataFrame:
    return search.unique_suffixes(h.files.where("NOT deleted"), 2)


@register("j18_nearest_manifest", """
SELECT f.id, CASE WHEN f.path LIKE 'src/promo/%' THEN 'src/promo' WHEN f.path LIKE 'src/%' THEN 'src' ELSE '' END AS manifest FROM files f""")
def nearest_manifest(h: History) -> DataFrame:
    manifests = h.spark.createDataFrame([("",), ("src",), ("src/promo",)], "dir string")
    return search.nearest_above(h.files.select("id", "path"), manifests).select("id", F.col("dir").alias("manifest"))


@register("j20_sha_prefix_unique", """
SELECT c.id, min(m.id) AS target FROM (SELECT id, regexp_extract(body, 'This reverts commit ([0-9a-f]{7,40})', 1) AS prefix FROM commits) c
JOIN commits m ON c.prefix <> '' AND starts_with(m.sha, c.prefix) GROUP BY c.id HAVING count(*) = 1""")
def sha_prefix(h: History) -> DataFrame:
    return search.reverted_commits(h.commits)


@register("j22_checked_calls_override", "SELECT file_id, line, callee, 'checked' AS via FROM calls WHERE line % 4 = 0 UNION ALL SELECT file_id, line, callee, 'named' FROM calls WHERE (file_id, line) NOT IN (SELECT (file_id, line) FROM calls WHERE line % 4 = 0)")
def override(h: History) -> DataFrame:
    checked = h.calls.where("line % 4 = 0")
    named = h.calls.join(checked.select("file_id", "line").distinct(), ["file_id", "line"], "left_anti")
    return checked.withColumn("via", F.lit("checked")).unionByName(named.withColumn("via", F.lit("named"))).select("file_id", "line", "callee", "via")


@register("j23_mutual_lineage", """
SELECT min(symbol_id) FILTER (born) AS born, min(symbol_id) FILTER (NOT born) AS removed, commit_id FROM lineage_sides
GROUP BY commit_id, kind, shape HAVING count(*) FILTER (born) = 1 AND count(*) FILTER (NOT born) = 1""")
def mutual_lineage(h: History) -> DataFrame:
    """Symbols born and removed in one commit with one kind and text, one of each."""
    side = lambda born, name: h.lineage_sides.where(born).select("commit_id", "kind", "shape", F.col("symbol_id").alias(name))
    return search.mutually_unique(side("born", "born"), side("NOT born", "removed"), ["commit_id", "kind", "shape"]).select("born", "removed", "commit_id")


@register("u3_first_wins", "SELECT type, number, commit_id FROM (SELECT *, row_number() OVER (PARTITION BY type, number ORDER BY commit_id) AS n FROM discussions) d WHERE n = 1")
def first_wins(h: History) -> DataFrame:
    return search.one_per(h.discussions, ["type", "number"], [F.col("commit_id")]).select("type", "number", "commit_id")


@register("u2_last_wins", "SELECT type, number, commit_id FROM (SELECT *, row_number() OVER (PARTITION BY type, number ORDER BY commit_id DESC) AS n FROM discussions) d WHERE n = 1")
def last_wins(h: History) -> DataFrame:
    return search.one_per(h.discussions, ["type", "number"], [F.desc("commit_id")]).select("type", "number", "commit_id")


@register("u4_removed_symbols", "SELECT DISTINCT p.symbol_id, p.commit_id + 1 AS commit_id FROM symbol_versions p JOIN (SELECT DISTINCT commit_id FROM symbol_versions) k ON k.commit_id = p.commit_id + 1 WHERE (p.symbol_id, p.commit_id + 1) NOT IN (SELECT (symbol_id, commit_id) FROM symbol_versions)")
def removed_symbols(h: History) -> DataFrame:
    before = h.symbol_versions.select("symbol_id", (F.col("commit_id") + 1).alias("commit_id")).distinct()
    now = h.symbol_versions.select("symbol_id", "commit_id").distinct()
    return before.join(now.select("commit_id").distinct(), "commit_id", "left_semi").join(now, ["symbol_id", "commit_id"], "left_anti").select("symbol_id", "commit_id")


@register("u6_head_reconciliation", "SELECT coalesce(f.id, h.id) AS id, CASE WHEN f.id IS NULL THEN 'added' WHEN h.id IS NULL THEN 'removed' ELSE 'kept' END AS state FROM (SELECT id FROM files WHERE NOT deleted) f FULL JOIN (SELECT id FROM files WHERE id % 10 <> 3) h ON f.id = h.id")
def reconcile(h: History) -> DataFrame:
    known, head = h.files.where("NOT deleted").select("id", F.lit(1).alias("known")), h.files.where("id % 10 <> 3").select("id", F.lit(1).alias("head"))
    state = F.when(F.col("known").isNull(), "added").when(F.col("head").isNull(), "removed").otherwise("kept")
    return known.join(head, "id", "full").select("id", state.alias("state"))


@register("w3_occurrences", "SELECT id, file_id, CASE WHEN n = 1 THEN name ELSE name || '#' || n END AS stable_key FROM (SELECT *, row_number() OVER (PARTITION BY file_id, name ORDER BY start_line, id) AS n FROM symbols) s")
def occurrences(h: History) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("file_id", "name").orderBy("start_line", "id"))
    return h.symbols.withColumn("n", n).select("id", "file_id", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat_ws("#", "name", "n")).alias("stable_key"))


@register("w6_changed_versions", "SELECT symbol_id, commit_id FROM (SELECT symbol_id, commit_id, content_hash, lag(content_hash) OVER (PARTITION BY symbol_id ORDER BY commit_id) AS before FROM symbol_versions) v WHERE before IS NULL OR before <> content_hash")
def changed_versions(h: History) -> DataFrame:
    before = F.lag("content_hash").over(Window.partitionBy("symbol_id").orderBy("commit_id"))
    return h.symbol_versions.withColumn("before", before).where("before IS NULL OR before <> content_hash").select("symbol_id", "commit_id")


@register("a25_first_last_touch", "SELECT file_id, arg_min(commit_id, commit_id) AS first_commit, max(commit_id) AS last_commit, strftime(min(committed_at), '%Y-%m-%d') AS first_day, strftime(max(committed_at), '%Y-%m-%d') AS last_day FROM (SELECT file_id, commit_id, committed_at FROM dated_changes UNION ALL SELECT previous_file_id, commit_id, committed_at FROM dated_changes WHERE previous_file_id IS NOT NULL) t GROUP BY file_id")
def first_last(h: History) -> DataFrame:
    """Decided by commit date, not by arrival; a rename touches its source path too."""
    c = h.dated_changes
    touches = c.select("file_id", "commit_id", "committed_at").unionByName(c.where("previous_file_id IS NOT NULL").select(F.col("previous_file_id").alias("file_id"), "commit_id", "committed_at"))
    return touches.groupBy("file_id").agg(F.min("commit_id").alias("first_commit"), F.max("commit_id").alias("last_commit"), F.date_format(F.min("committed_at"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("committed_at"), "yyyy-MM-dd").alias("last_day"))


@register("m3_lookups", "SELECT provider, number, max(commit_id) AS id FROM discussions WHERE type = 'issue' GROUP BY provider, number")
def lookups(h: History) -> DataFrame:
    return h.discussions.where("type = 'issue'").groupBy("provider", "number").agg(F.max("commit_id").alias("id"))


@register("m11_dangling_links", "SELECT r.id FROM relations r WHERE (source_type = 'file' AND source_id NOT IN (SELECT id FROM files)) OR (target_type = 'file' AND target_id NOT IN (SELECT id FROM files)) OR (target_type = 'symbol' AND target_id NOT IN (SELECT id FROM symbols))")
def dangling(h: History) -> DataFrame:
    return search.dangling(h.relations, {"file": h.files, "symbol": h.symbols}, [("source", "file"), ("target", "file"), ("target", "symbol")]).select("id")
