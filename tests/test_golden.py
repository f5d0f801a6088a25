"""Small exact cases of the history operators."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronolith.functions import levels, paths, text
from chronolith.operators import activity, commit_graph, graph, intent, linking, people
from chronolith.plans.registry import ready
from chronolith.sources import repository
from chronolith.streaming import ingest


def at(day, month=1, year=2026):
    return dt.datetime(year, month, day)


CHANGE = "id long, file_id long, commit_id long, status string, previous_file_id long, additions long, deletions long, committed_at timestamp_ntz"
FILE = "id long, path string, deleted boolean"


def test_reach_with_a_cycle(spark):
    ready(spark)
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 2), (3, 1)], "source long, target long")
    tests = spark.createDataFrame([(i, i == 4) for i in range(1, 5)], "id long, is_test boolean")
    full = {r.file_id: (r.dependents, r.tests) for r in activity.import_reach(edges, tests).collect()}
    assert full[3] == (3, 1) and full[2] == (3, 1) and 4 not in full
    near = {r.file_id: (r.dependents, r.tests) for r in activity.import_reach(edges, tests, 1).collect()}
    assert near[3] == (1, 0)


def test_activity_follows_renames_until_the_rename(spark):
    files = spark.createDataFrame([(1, "old.ts", True), (2, "new.ts", False)], FILE)
    rows = [(1, 1, 10, "added", None, 3, 0, at(1)), (2, 1, 11, "modified", None, 2, 1, at(2)), (3, 2, 12, "renamed", 1, 0, 0, at(3)), (4, 2, 13, "modified", None, 1, 1, at(4))]
    only = activity.file_activity(files, spark.createDataFrame(rows, CHANGE)).collect()
    assert [(r.file_id, r.churn, r.commits, r.last_changed_at) for r in only] == [(2, 8, 3, at(4))]
    reused = [(1, 1, 10, "added", None, 3, 0, at(1)), (2, 2, 11, "renamed", 1, 0, 0, at(2)), (3, 1, 12, "added", None, 5, 0, at(3)), (4, 2, 13, "modified", None, 1, 0, at(4))]
    (row,) = activity.file_activity(files, spark.createDataFrame(reused, CHANGE)).collect()
    assert (row.churn, row.commits) == (4, 2)


def test_binary_changes_and_since(spark):
    files = spark.createDataFrame([(1, "a.png", False)], FILE)
    rows = [(1, 1, 10, "modified", None, None, None, at(1)), (2, 1, 11, "modified", None, None, None, at(5))]
    (row,) = activity.file_activity(files, spark.createDataFrame(rows, CHANGE), since="2026-01-03").collect()
    assert (row.churn, row.binary_changes) == (0, 1)


def test_defects(spark):
    subjects = ["resolve it", 'Revert "x"', "fix(core): y", "broken header", "fix typo", "Update z"]
    commits = spark.createDataFrame([(i, s, "") for i, s in enumerate(subjects)], "id long, subject string, body string")
    talks = spark.createDataFrame([(0, "issue", "12", "github", "bug", "RESOLVED_BY", "DERIVED", 0.9), (5, "issue", "P-1", "jira", "type: Regression", "REFERENCES", "DERIVED", 1.0), (4, "issue", "P-2", "jira", "story", "REFERENCES", "DERIVED", 1.0)], "commit_id long, type string, number string, provider string, label string, relation string, level string, confidence double")
    found = {r.commit_id: (r.confidence, r.level) for r in activity.classify_defects(commits, talks).collect()}
    assert found == {0: (0.9, "DERIVED"), 1: (0.7, "INFERRED"), 2: (0.6, "INFERRED"), 3: (0.5, "INFERRED"), 5: (0.7, "INFERRED")}


def test_people_share_names_and_addresses(spark):
    ready(spark)
    rows = [(1, "Tj Holo", "tj@x.org", at(1)), (2, "TJ  HOLO", "other@x.org", at(2)), (3, "visionmedia", "TJ@x.org", at(3)), (4, "a", "1+noreply@h.com", at(4)), (5, "b", "1+noreply@h.com", at(5, year=2015))]
    commits = spark.createDataFrame(rows, "id long, author_name string, author_email string, committed_at timestamp_ntz")
    names = people.identities(commits)
    table = {r.person: (r.commits, r.active) for r in people.people(commits, names).collect()}
    assert table == {"visionmedia": (3, True), "a": (1, True), "b": (1, False)}


def greedy(owned):
    """The same by removing one person at a time."""
    left = {}
    for r in owned.where("place = 1 OR share >= 0.25").collect():
        left.setdefault(r.file_id, set()).add(r.person)
    gone, total = [], len(left)
    while total and 2 * sum(not s for s in left.values()) <= total:
        counts = {}
        for s in left.values():
            for p in s:
                counts[p] = counts.get(p, 0) + 1
        gone.append(min(counts, key=lambda p: (-counts[p], p)))
        for s in left.values():
            s.discard(gone[-1])
    return gone


def test_ownership_and_truck_factor(spark):
    ready(spark)
    commits = spark.createDataFrame([(1, "ann", "ann@x.org", at(1, year=2020)), (2, "bob", "bob@x.org", at(1))], "id long, author_name string, author_email string, committed_at timestamp_ntz")
    rows = spark.createDataFrame([(7, "a.ts", 1, 10, 0), (7, "a.ts", 2, 2, 0), (8, "b.ts", 1, 5, 0), (9, "c.ts", 2, 4, 0)], "root long, path string, commit_id long, additions long, deletions long")
    names = people.identities(commits)
    owned = people.ownership(rows, commits, names, people.people(commits, names))
    shares = {(r.file_id, r.person): (r.share, r.at_risk) for r in owned.collect()}
    assert shares[7, "ann"] == (0.833, True) and shares[7, "bob"] == (0.167, False)
    assert [r.person for r in people.truck_factor(owned).orderBy("place").collect()] == greedy(owned)


def test_versions_deadlines_and_minimums(spark):
    one = spark.range(1)
    found = one.select(text.version_references(F.lit("Node 14, node.js v12.1, Python 2.7, python 3, Go 1.20, rustc 1.56")).alias("v")).first().v
    assert [(r.runtime, r.major, r.minor) for r in found] == [("node", 14, None), ("node", 12, 1), ("python", 2, 7), ("python", 3, None), ("go", 1, 20), ("rust", 1, 56)]
    ends = one.select(*[text.deadline_end(F.lit(w)).cast("string").alias(f"d{i}") for i, w in enumerate(["2024-06", "Q1 2025", "2023-02-14", "2026", "2024-13", "1999", "2024-02-31"])]).first()
    assert tuple(ends) == ("2024-06-30", "2025-03-31", "2023-02-14", "2026-12-31", None, None, "2024-03-02")
    least = one.select(*[text.minimum_version(F.lit(c)).alias(f"m{i}") for i, c in enumerate([">=20 <23", "^18 || ^20.1", "<3.9", ">=3.10", "1.x"])]).first()
    assert [tuple(m) if m else None for m in least] == [(20, 0), (18, 0), None, (3, 10), (1, 0)]


def test_workaround_wording(spark):
    texts = ["Handle export\n\nWorkaround for legacy invoices", "remove deprecated createServer()", "Add legacy shim", "plain", "remove once Node 14 is gone"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", intent.workaround(F.col("t")).alias("m")).collect()
    assert {r.i: (r.m.phrase, r.m.in_first_line) if r.m else None for r in rows} == {0: ("Workaround", False), 1: None, 2: ("legacy", True), 3: None, 4: ("remove once", True)}


def test_references(spark):
    rows = spark.range(1).select(F.explode(text.reference_rows(F.lit("Fixes #12 and see GH-3, own/repo#4, acme/x#5; page#9 &#8;"), "own", "repo")).alias("r")).select("r.*").collect()
    assert {(r.number, r.repo, r.closing) for r in rows} == {(12, None, True), (3, None, False), (4, None, False), (5, "acme/x", False)}


def test_paths(spark):
    rows = spark.createDataFrame([(p,) for p in ["src/a.test.ts", "dist/x.js", "README.md", "latest.java", "CartTest.java", ".gitignore", "src/x.d.mts", "docs/a.py"]], "path string")
    p = F.col("path")
    table = {r.path: tuple(r)[1:] for r in rows.select("path", paths.is_test(p), paths.is_generated(p), F.coalesce(paths.is_code(p), F.lit(False)), paths.is_declaration(p), paths.is_illustrative(p)).collect()}
    assert table["src/a.test.ts"][0] and table["dist/x.js"][1] and not table["README.md"][2] and not table["latest.java"][0] and table["CartTest.java"][0]
    assert not table[".gitignore"][2] and table["src/x.d.mts"][3] and table["docs/a.py"][4]
    assert rows.select(paths.ancestors(F.lit("a/b/c.ts")).alias("a")).first().a == ["a/b", "a", ""]


def test_levels(spark):
    rows = spark.createDataFrame([("FACT",), ("INFERRED",), ("DERIVED",)], "level string")
    assert rows.agg(levels.weakest(F.col("level"))).first()[0] == "INFERRED"
    assert rows.limit(0).agg(levels.weakest(F.col("level"))).first()[0] == "FACT"
    bad = spark.createDataFrame([("FACT", 0.9, [1]), ("INFERRED", 0.5, []), ("DERIVED", 1.5, [1]), ("DERIVED", 0.5, None)], "level string, confidence double, evidence_ids array<bigint>")
    assert levels.invalid_relations(bad).count() == 3


def test_traversal_bounds(spark):
    ready(spark)
    rows = [(i, "commit", c, "MODIFIES", "file", 1, 1.0, "FACT") for i, c in enumerate((5, 6, 7))] + [(9, "issue", 3, "RESOLVED_BY", "commit", 7, 0.9, "DERIVED")]
    relations = spark.createDataFrame(rows, "id long, source_type string, source_id long, relation string, target_type string, target_id long, confidence double, level string")
    starts = spark.createDataFrame([("file:1",)], "key string")
    paths, cuts = graph.beam(starts, relations, "history", max_fan_out=1)
    (one,) = paths.collect()
    assert one.nodes == ["file:1", "commit:7", "issue:3"] and one.level == "DERIVED" and one.confidence == 0.9
    assert [r.cut for r in cuts.collect()] == ["MODIFIES (in) from file:1: followed 1 of 3"]
    shallow, cuts = graph.beam(starts, relations, "history", max_depth=1)
    assert {r.nodes[1] for r in shallow.collect()} == {"commit:5", "commit:6", "commit:7"} and [r.cut for r in cuts.collect()] == ["stopped at depth 1"]
    sure, cuts = graph.beam(starts, relations, "history", min_confidence=0.95)
    assert {tuple(r.nodes) for r in sure.collect()} == {("file:1", f"commit:{c}") for c in (5, 6, 7)} and [r.cut for r in cuts.collect()] == ["links below confidence 0.95 were not followed"]
    few, cuts = graph.beam(starts, relations, "history", max_paths=1, max_depth=1)
    assert [r.nodes for r in few.collect()] == [["file:1", "commit:5"]] and {r.cut for r in cuts.collect()} == {"more than 1 paths; kept the strongest", "stopped at depth 1"}
    whole, cuts = graph.beam(starts, relations, "history")
    assert whole.count() == 3 and cuts.isEmpty()


def test_fan_out_counts_what_leads_back_into_the_path(spark):
    ready(spark)
    rows = [(i, "symbol", 2, "CALLS", "symbol", 1, 1.0, "FACT") for i in range(5)] + [(10 + i, "symbol", 1, "CALLS", "symbol", 2, 1.0, "FACT") for i in range(4)] + [(20 + i, "symbol", 30 + i, "CALLS", "symbol", 2, 0.5, "DERIVED") for i in range(3)]
    relations = spark.createDataFrame(rows, "id long, source_type string, source_id long, relation string, target_type string, target_id long, confidence double, level string")
    paths, cuts = graph.beam(spark.createDataFrame([("symbol:1",)], "key string"), relations, "callers", max_fan_out=2)
    assert {r.cut for r in cuts.collect()} == {"CALLS (in) from symbol:1: followed 2 of 5", "CALLS (in) from symbol:2: followed 2 of 3"}
    assert sorted(r.nodes[2] for r in paths.collect()) == ["symbol:31", "symbol:31", "symbol:32", "symbol:32"]


def test_neighbourhood_tells_its_cut(spark):
    ready(spark)
    rows = [(i, "commit", c, "MODIFIES", "file", f, 1.0, "FACT") for i, (c, f) in enumerate([(1, 1), (1, 2), (2, 2), (2, 3), (3, 1)])]
    relations = spark.createDataFrame(rows, "id long, source_type string, source_id long, relation string, target_type string, target_id long, confidence double, level string")
    starts = spark.createDataFrame([("file:1",), ("file:9",)], "key string")
    nodes, links, cuts = graph.neighbourhood(starts, relations, 2)
    assert {(r.start, r.key, r.distance) for r in nodes.collect()} == {("file:1", "file:1", 0), ("file:1", "commit:1", 1), ("file:1", "commit:3", 1), ("file:1", "file:2", 2), ("file:9", "file:9", 0)}
    assert {r.id for r in links.collect()} == {0, 1, 4} and cuts.isEmpty()
    nodes, links, cuts = graph.neighbourhood(starts, relations, 2, 2)
    assert {r.key for r in nodes.where("start = 'file:1'").collect()} == {"file:1", "commit:1"} and {r.id for r in links.collect()} == {0}
    assert [(r.start, r.cut) for r in cuts.collect()] == [("file:1", "stopped at 2 nodes")]


def test_log_records(spark, tmp_path):
    head = ["a" * 40, "p" * 40, "Ann", "a@x", "2026-01-01T09:00:00+02:00", "Ann", "2026-01-01T09:00:00+02:00", "subject", "body\n"]
    raw = ":100644 100644 1a 2b M\0src/a.ts\0:100644 100644 1a 2b R100\0old.ts\0new.ts\0:000000 100644 00 2b A\0x.png\0" + "3\t1\tsrc/a.ts\0" + "0\t0\t\0old.ts\0new.ts\0" + "-\t-\tx.png\0"
    merge = ["b" * 40, "p q", "Bob", "b@x", head[4], "Bob", head[4], "Merge", ""]
    (tmp_path / "log").write_text("".join("\x1e" + "\x1f".join([*h, r]) for h, r in ((head, raw), (merge, ""))))
    rows = {r.sha[0]: r for r in repository.parse_commits(repository.read_log(spark, str(tmp_path / "log"))).collect()}
    assert [tuple(c) for c in rows["a"].changes] == [("modified", "src/a.ts", None, 3, 1), ("renamed", "new.ts", "old.ts", 0, 0), ("added", "x.png", None, None, None)]
    assert rows["a"].committed_at == dt.datetime(2026, 1, 1, 7) and rows["b"].changes == [] and rows["b"].parents == ["p", "q"]


def test_coverage_and_manifests(spark):
    report = "SF:a.ts\nDA:1,2\nDA:2,0\nDA:x,1\nend_of_record\nDA:9,9\nSF:b.ts\nDA:5,1\nend_of_record\nSF:a.ts\nDA:2,1\nDA:3,0\nend_of_record\n"
    found = {r.path: (r.found, r.hit) for r in repository.read_coverage(spark.createDataFrame([("r", report)], "report string, content string")).collect()}
    assert found == {"a.ts": ([1, 2, 3], [1, 2]), "b.ts": ([5], [5])}
    files = [("package.json", '{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}'), ("go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgolang.org/x v0.1.0 // indirect\n)"), ("x/requirements-dev.txt", "Foo_Bar[x]>=1 # c\n-r y\n"), ("node_modules/z/package.json", '{"dependencies": {"n": "1"}}'), ("bad/package.json", "{")]
    rows = repository.read_manifests(spark.createDataFrame(files, "path string, content string")).collect()
    assert {(r.ecosystem, r.name, r.version, r.scope) for r in rows} == {("npm", "a", "^1", "runtime"), ("npm", "b", "2", "development"), ("go", "github.com/a/b", "v1.2.3", "runtime"), ("go", "golang.org/x", "v0.1.0", "indirect"), ("pypi", "foo-bar", ">=1", "runtime")}


def test_incremental_ingest_takes_each_key_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    take = lambda: ingest.ingest_new(ingest.stream_of(spark, source, 1), target, state, "sha")
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "sha long, v string").write.parquet(source)
    take()
    spark.createDataFrame([(2, "b"), (3, "c")], "sha long, v string").write.mode("append").parquet(source)
    take()
    take()
    assert sorted(r.sha for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_a_single_file_is_streamed_without_its_siblings(spark, tmp_path):
    for name, n in (("events.parquet", 3), ("events.parquet2.parquet", 5)):
        pq.write_table(pa.table({"sha": list(range(n))}), tmp_path / name)
    ingest.ingest_new(ingest.stream_of(spark, str(tmp_path / "events.parquet")), str(tmp_path / "out"), str(tmp_path / "state"), "sha")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_unknown_attribute_of_history(spark):
    from chronolith.sources.driver_tables import History

    with pytest.raises(AttributeError):
        History(spark, "/nowhere").nothing


def test_long_rename_lineage(spark):
    rows = [(k, k, k + 1, f"2024-01-{28 - k:02d} 00:00:00") for k in range(1, 10)] + [(10, 10, 1, "2024-01-01 00:00:00")]
    changes = spark.createDataFrame(rows, "id long, file_id long, previous_file_id long, at string").selectExpr("id", "file_id", "previous_file_id", "'renamed' AS status", "cast(at AS timestamp_ntz) AS committed_at")
    found = activity.rename_lineage(spark.createDataFrame([(1,)], "id long"), changes)
    assert sorted(r.file_id for r in found.collect()) == list(range(1, 11))


def test_traversal_without_caps_keeps_every_path(spark):
    relations = spark.range(10_500).selectExpr("id", "'MODIFIES' AS relation", "'commit' AS source_type", "id AS source_id", "'file' AS target_type", "1L AS target_id", "1.0D AS confidence", "'FACT' AS level")
    starts = spark.createDataFrame([("file:1",)], "key string")
    assert graph.traverse(starts, relations, "history", max_depth=1).count() == 10_500


def test_targets_by_every_rule(spark):
    commits = spark.createDataFrame([(1, "abcdef1234567890"), (2, "abcdef9999999999")], "id long, sha string")
    files = spark.createDataFrame([(1, "src/a.ts"), (2, "src/b.ts")], "id long, path string")
    symbols = spark.createDataFrame([(1, 1, "vat", "Tax.vat", True), (2, 2, "vat", "vat", False), (3, 1, "sum", "sum", True), (4, 2, "sum", "sum", True), (5, 2, "old", "old", False)], "id long, file_id long, name string, qualified_name string, current boolean")
    talks = spark.createDataFrame([("issue", 7, 12), ("pull_request", 9, 12)], "type string, id long, number long")
    needs = spark.createDataFrame([(3, "npm", "zod"), (4, "go", "zod")], "id long, ecosystem string, name string")
    asked = ["#12", "GH-12", "npm:zod", "ABCDEF1", "abcdef12", "ab", "", "  ", "src\\a.ts", "src/b.ts:vat", "vat", "sum", "old", "Tax.vat"]
    found = linking.resolve_targets(spark.createDataFrame([(a,) for a in asked], "input string"), commits, files, symbols, talks, needs)
    got = {}
    for r in found.collect():
        got.setdefault(r.input, set()).add((r.kind, r.id))
    assert got == {
        "#12": {("issue", 7), ("pull_request", 9)}, "GH-12": {("issue", 7), ("pull_request", 9)}, "npm:zod": {("dependency", 3)}, "ABCDEF1": {("commit", 1)}, "abcdef12": {("commit", 1)}, "src\\a.ts": {("file", 1)},
        "src/b.ts:vat": {("symbol", 2)}, "vat": {("symbol", 1)}, "sum": {("symbol", 3), ("symbol", 4)}, "old": {("symbol", 5)}, "Tax.vat": {("symbol", 1)},
    }


def test_importers_that_name_other_things_are_skipped(spark):
    symbols = spark.createDataFrame([(1, 10, "f"), (2, 10, "C.m")], "id long, file_id long, qualified_name string")
    defined = spark.createDataFrame([(10, "f"), (10, "C"), (10, "C.m")], "file_id long, qualified_name string")
    edges = spark.createDataFrame([(s, 10) for s in range(20, 26)] + [(10, 10)], "source long, target long")
    names = spark.createDataFrame([(20, 10, "f"), (21, 10, "C"), (22, 10, "*"), (23, 10, "alias"), (24, 10, "f"), (24, 10, "C.m")], "source long, target long, imported string")
    uses = {(r.id, r.node): r.uses for r in graph.symbol_importers(symbols, edges, names, defined).collect()}
    assert {n for (i, n), u in uses.items() if i == 1 and u} == {20, 22, 23, 24, 25} and {n for (i, n), u in uses.items() if i == 2 and u} == {21, 22, 23, 24, 25}
    callers = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "root long, node long, distance int")
    told = {r.id: r for r in graph.symbol_impact(symbols, callers, spark.createDataFrame([(1, 20, True, True), (1, 21, False, False)], "id long, node long, uses boolean, is_test boolean")).collect()}
    assert told[1].answer == "1 caller calls it directly and 1 through other calls. 1 file imports the file that defines it (1 of them tests)." and told[1].skipped == 1
    assert told[2].answer == "No call to it was resolved. Nothing in the index depends on it."


def test_index_freshness(spark):
    ready(spark)
    places, cross = commit_graph.commit_graph(spark.createDataFrame([(i, i) for i in range(1, 6)], "commit_id long, number long"), spark.createDataFrame([(2, 1, 0), (3, 2, 0), (4, 2, 0), (5, 4, 0)], "commit_id long, parent_id long, ordinal int"))
    cases = [(5, 5, "current"), (None, 5, "unindexed"), (2, 5, "behind"), (3, 5, "diverged"), (99, 5, "unknown"), (3, None, "diverged"), (None, None, "current")]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, indexed long, head long")
    assert {r.k: r.freshness for r in commit_graph.index_freshness(frame, places, cross).collect()} == {k: c[2] for k, c in enumerate(cases)}
