"""Landed pages, upserts, saved answers, export, Python symbols, import resolution and lineage."""

import datetime as dt
import json

from pyspark.sql import functions as F

from chronolith.operators import imports, linkers, stories
from chronolith.sources import landed, python_symbols


def test_landed_items_and_the_mark(spark, tmp_path):
    page = [
        {"number": 1, "title": "a", "body": None, "state": "open", "user": {"login": "x"}, "labels": [{"name": "bug"}], "created_at": "2026-01-01T00:00:00Z", "updated_at": "2026-01-02T00:00:00Z"},
        {"number": 2, "title": "b", "state": "closed", "updated_at": "2026-01-03T00:00:00Z", "pull_request": {"merged_at": "2026-01-03T00:00:00Z"}},
    ]
    newer = [{"number": 1, "title": "a2", "state": "closed", "updated_at": "2026-01-05T00:00:00Z"}]
    (tmp_path / "p1.json").write_text(json.dumps(page))
    (tmp_path / "p2.json").write_text(json.dumps(newer))
    items = landed.read_items(spark, str(tmp_path))
    rows = {r.number: r for r in items.collect()}
    assert (rows[1].title, rows[1].type, rows[1].labels) == ("a2", "issue", []) and rows[2].type == "pull_request"
    assert landed.high_water_mark(items) == "2026-01-05T00:00:00Z"
    assert [r.number for r in landed.read_items(spark, str(tmp_path), "2026-01-04T00:00:00Z").collect()] == [1]
    assert landed.high_water_mark(items.limit(0)) is None


def test_upsert_keeps_the_later_stamp(spark):
    stored = spark.createDataFrame([(1, "old", 5), (2, "kept", 9)], "number long, v string, updated_at long")
    fresh = spark.createDataFrame([(1, "new", 5), (2, "late", 3), (3, "first", 1)], "number long, v string, updated_at long")
    assert {r.number: r.v for r in landed.upsert(stored, fresh, ["number"]).collect()} == {1: "new", 2: "kept", 3: "first"}


def test_investigations_and_export(spark, tmp_path):
    answers = spark.createDataFrame([("q1", "why", "because", 0.5, "INFERRED", dt.datetime(2026, 1, 1)), ("q2", "why", "x", 1.0, "FACT", dt.datetime(2026, 1, 2))], "question string, kind string, answer string, confidence double, level string, asked_at timestamp")
    path = str(tmp_path / "saved")
    stories.save_investigation(answers.limit(1), path)
    stories.save_investigation(answers, path)
    assert [r.question for r in stories.saved_investigations(spark, path, 2).collect()] == ["q2", "q1"]
    stories.export_graph(answers.select("question"), answers.select("level"), str(tmp_path / "graph"))
    assert spark.read.json(str(tmp_path / "graph")).groupBy("type").count().count() == 2


def test_questions_keywords_and_grounding(spark):
    rows = spark.createDataFrame([(1, "Why does src/tax/vat.ts exist?"), (2, "what depends on cart"), (3, "hello there"), (4, "history of Cart")], "question_id long, text string")
    assert {r.question_id: r.k for r in rows.select("question_id", stories.question_kind(F.col("text")).alias("k")).collect()} == {1: "why", 2: "impact", 3: None, 4: "timeline"}
    entities = spark.createDataFrame([("file:1", "src/tax/vat.ts"), ("symbol:2", "cart"), *[(f"x:{i}", "does") for i in range(5)]], "key string, word string")
    assert {(r.question_id, r.key) for r in stories.grounding(rows, entities).collect()} == {(1, "file:1"), (2, "symbol:2"), (4, "symbol:2")}


SOURCE = '''import os, a.b
from .c import d as e

class Cart:
    def total(self):
        return helper(self.rate)

def helper(x):
    def inner():
        return os.path.join(x)
    return inner()
'''


def test_python_symbols(spark):
    files = spark.createDataFrame([("m.py", SOURCE), ("bad.py", "def ("), ("x.txt", SOURCE), ("none.py", None)], "path string, content string")
    found = {(r.qualified_name, r.kind, r.start_line, r.end_line) for r in python_symbols.symbols(files).collect()}
    assert found == {("Cart", "class", 4, 6), ("Cart.total", "method", 5, 6), ("helper", "function", 8, 11), ("helper.inner", "function", 9, 10)}
    assert {(r.specifier, r.name) for r in python_symbols.imports(files).collect()} == {("os", "*"), ("a.b", "*"), (".c", "d")}
    assert {(r.caller, r.callee, r.line) for r in python_symbols.calls(files).collect()} == {("Cart.total", "helper", 6), ("helper.inner", "os.path.join", 10), ("helper", "inner", 11)}


def test_shape_ignores_the_own_name():
    one, two = (python_symbols.definitions(f"def {n}(x):\n    return {n}(x - 1)\n")[0] for n in ("fact", "f2"))
    assert one[4] != two[4] and one[5] == two[5]


def test_import_resolution(spark):
    files = spark.createDataFrame([(p,) for p in ["src/a.ts", "src/b/index.ts", "src/c.d.ts", "pkg/__init__.py", "pkg/m.py", "x/util.py", "y/util.py", "z/only.py"]], "path string")
    rows = spark.createDataFrame([(1, "src/b/x.ts", "../a"), (2, "src/z.ts", "./b"), (3, "src/z.ts", "./a.js"), (4, "src/z.ts", "../../a"), (5, "src/z.ts", "./c"), (6, "q.py", "pkg.m"), (7, "q.py", "util"), (8, "q.py", "only"), (9, "q.py", "pkg")], "import_id long, path string, specifier string")
    near = {r.import_id: r.target for r in imports.relative_imports(rows, files).collect()}
    assert near == {1: "src/a.ts", 2: "src/b/index.ts", 3: "src/a.ts", 5: "src/c.d.ts"}
    python = {r.import_id: (r.target, r.confidence) for r in imports.python_imports(rows.where("import_id > 5"), files).collect()}
    assert python == {6: ("pkg/m.py", 1.0), 8: ("z/only.py", 0.9), 9: ("pkg/__init__.py", 1.0)}


def test_lineage_needs_both_sides_unique(spark):
    schema = "commit_id long, symbol_id long, file_id long, kind string, qualified_name string, shape string"
    born = spark.createDataFrame([(1, 10, 1, "function", "new", "s1"), (1, 11, 2, "function", "moved", "s2"), (1, 12, 1, "function", "twin", "s3")], schema)
    removed = spark.createDataFrame([(1, 20, 1, "function", "old", "s1"), (1, 21, 3, "function", "moved", "s9"), (1, 22, 1, "function", "p", "s3"), (1, 23, 1, "function", "q", "s3")], schema)
    found = {(r.born, r.removed, r.method, r.confidence) for r in linkers.symbol_lineage(born, removed).collect()}
    assert found == {(10, 20, "renamed", 0.9), (11, 21, "moved-with-edits", 0.6)}


def test_commit_references_know_reverts(spark):
    sha = "ab" * 20
    commits = spark.createDataFrame([(1, sha, "one", "Fixes #1"), (2, "c" * 40, 'Revert "one"', f"This reverts commit {sha}. Fixes #2"), (3, "d" * 40, "x", "closes #2, see #1 and #9")], "id long, sha string, subject string, body string")
    issues = spark.createDataFrame([(1,), (2,)], "number long")
    found = {(r.commit_id, r.number, r.relation) for r in linkers.commit_references(commits, issues, "own", "repo").collect()}
    assert found == {(1, 1, "REFERENCES"), (2, 2, "REFERENCES"), (3, 2, "RESOLVED_BY"), (3, 1, "REFERENCES")}
