"""Why answers on small evidence: copies followed, chains multiplied, gaps stated, evidence cited once."""

import datetime as dt

import pytest

from chronolith.operators import why
from chronolith.plans.registry import ready

RELATION = "id long, source_type string, source_id long, relation string, target_type string, target_id long, confidence double, level string, method string"


@pytest.fixture(scope="module")
def tables(spark):
    ready(spark)
    day = lambda n: dt.datetime(2025, 1, n)
    commits = [(n, f"{n:07d}abc", who, f"{who}@x", day(n), f"work {n}", body) for n, who, body in ((1, "Ann", "Because\n of it.\n\nMore."), (2, "Bob", ""), (3, "ann", ""), (4, "Cid", ""))]
    symbols = [(10, 1, "f", "f", "function", 1, 9, True), (11, 2, "f", "f", "function", 5, 8, True), (12, 2, "g", "g", "class", 1, 3, False), (13, 1, "h", "A.h", "method", 2, 3, True), (14, 1, "i", "i", "function", 1, 1, True)]
    relations = [
        (1, "file", 1, "CONTAINS", "symbol", 10, 1.0, "FACT", None), (2, "symbol", 10, "COPIED_FROM", "symbol", 11, 0.9, "DERIVED", "renamed"), (3, "symbol", 11, "COPIED_FROM", "symbol", 12, 0.6, "INFERRED", "moved-with-edits"),
        (4, "symbol", 12, "COPIED_FROM", "symbol", 10, 0.9, "DERIVED", "identical-content"), (5, "symbol", 12, "INTRODUCED_BY", "commit", 1, 0.8, "DERIVED", None), (6, "pull_request", 7, "IMPLEMENTED_BY", "commit", 1, 0.9, "DERIVED", None),
        (7, "issue", 8, "RESOLVED_BY", "pull_request", 7, 0.5, "INFERRED", None), (8, "issue", 9, "RESOLVED_BY", "commit", 1, 1.0, "FACT", None), (9, "pull_request", 7, "REFERENCES", "issue", 3, 1.0, "FACT", None), (10, "symbol", 13, "INTRODUCED_BY", "commit", 3, 1.0, "FACT", None),
        (11, "pull_request", 7, "IMPLEMENTED_BY", "commit", 4, 0.7, "INFERRED", None),
    ]
    return {
        "commits": spark.createDataFrame(commits, "id long, sha string, author_name string, author_email string, committed_at timestamp_ntz, subject string, body string"),
        "symbols": spark.createDataFrame(symbols, "id long, file_id long, name string, qualified_name string, kind string, start_line int, end_line int, current boolean"),
        "files": spark.createDataFrame([(1, "a.ts", False), (2, "b.ts", False), (3, "gone.ts", True)], "id long, path string, deleted boolean"),
        "versions": spark.createDataFrame([(10, 3), (10, 4), (11, 2), (12, 1), (13, 3), (13, 3)], "symbol_id long, commit_id long"),
        "relations": spark.createDataFrame(relations, RELATION),
        "covered": spark.createDataFrame([(10, 4, 3), (13, 0, 0), (12, 5, 5)], "key long, found int, hit int"),
    }


def answers(frame):
    return {r.key: r for r in frame.collect()}


def test_a_copied_symbol_is_traced_to_its_origin(tables):
    found = answers(why.symbols_why(*(tables[n] for n in ("symbols", "files", "versions", "relations", "commits", "covered"))))
    assert len(found) == 5
    copied = found[10]
    assert copied.answer == (
        'function f is defined in a.ts at lines 1–9. 3 of its 4 instrumented lines ran in the tests. '
        'It was renamed from function f in b.ts in commit 0000003 "work 3" by ann on 2025-01-03; the code is otherwise identical. '
        'That looks moved, with edits, from class g in b.ts in commit 0000002 "work 2" by Bob on 2025-01-02: that definition left its file in the same commit (inferred from the name, not the content). '
        'That code was introduced in commit 0000001 "work 1" by Ann on 2025-01-01. Its commit message explains: "Because of it." '
        "It is part of pull request #7. Pull request #7 resolves issue #8 (mentioned). The commit itself resolves issue #9 (recorded). "
        'It changed 1 time since, most recently in commit 0000004 "work 4" by Cid on 2025-01-04. '
        "Its 2 commits were made by 2 people, most by Cid (1). Cid still commits to the repository (last on 2025-01-04)."
    )
    assert copied.level == "INFERRED" and abs(copied.confidence - 0.8 * 0.9 * 0.5) < 1e-12 and copied.related == ["issue:3"]
    cited = {e.name: e.reasons for e in copied.evidence}
    assert cited["relation:3"] == "moved from" and cited["commit:0000001abc"] == "commit message; introducing commit" and cited["commit:0000004abc"] == "authors; later changes"
    alone = found[13]
    assert alone.answer.startswith("method A.h is defined in a.ts at lines 2–3. It was introduced in commit 0000003") and "It has not changed since." in alone.answer
    assert alone.answer.endswith("Its 1 commit was made by 1 person, most by ann (1). ann still commits to the repository (last on 2025-01-03).")
    unknown = found[14]
    assert why.NO_ORIGIN in unknown.answer and unknown.confidence == 1.0 and unknown.level == "DERIVED"
    assert "no longer exists at HEAD; it was last seen in b.ts" in found[12].answer and "instrumented" not in found[12].answer


def test_kinds_of_statements_are_made_one_after_the_other(tables):
    found = why.symbols_why(*(tables[n] for n in ("symbols", "files", "versions", "relations", "commits", "covered")))
    # Left to do: statements and related entities come to their symbol.
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 1 and len(found.inputFiles()) > 0


def test_files_commits_and_work(spark, tables):
    change = "id long, commit_id long, file_id long, status string, previous_file_id long, additions long, deletions long, committed_at timestamp_ntz"
    day = lambda n: dt.datetime(2025, 1, n)
    rows = [(1, 1, 2, "added", None, 5, 0, day(1)), (2, 2, 1, "renamed", 2, 0, 0, day(2)), (3, 3, 1, "modified", None, 1, 1, day(3)), (4, 4, 2, "modified", None, 1, 0, day(4))]
    found = answers(why.files_why(tables["files"], spark.createDataFrame(rows, change), tables["relations"], tables["commits"]))
    assert found[1].answer == (
        'a.ts exists at HEAD. It was created as b.ts in commit 0000001 "work 1" by Ann on 2025-01-01. Its commit message explains: "Because of it." It is part of pull request #7. '
        "Pull request #7 resolves issue #8 (mentioned). The commit itself resolves issue #9 (recorded). "
        'It was renamed from b.ts to a.ts in commit 0000002 "work 2" by Bob on 2025-01-02. It changed 1 time since, most recently in commit 0000003 "work 3" by ann on 2025-01-03.'
    )
    assert found[3].answer == f"gone.ts was deleted. {why.NO_ORIGIN} It has not changed since."
    commits = answers(why.commits_why(tables["relations"], tables["commits"]))
    assert commits[2].answer == 'This is commit 0000002 "work 2" by Bob on 2025-01-02.' and commits[2].related is None and commits[1].statements == 5
    work = answers(why.work_why(tables["relations"], tables["commits"]))
    assert work["pull_request:7"].answer == 'Pull request #7 is known. It is implemented by 2 indexed commits: commit 0000004 "work 4" by Cid on 2025-01-04; commit 0000001 "work 1" by Ann on 2025-01-01. It resolves issue #8 (mentioned).'
    assert work["pull_request:7"].level == "INFERRED" and work["issue:9"].answer.startswith("Issue #9 is known. It is resolved by commit 0000001") and work["issue:3"].related == ["pull_request:7"]


def test_evidence_of_a_hub_is_sorted_not_compared_pair_by_pair(spark):
    rows = spark.range(3000).selectExpr("'k' AS key", "1 AS step", "'' AS place", "'t' AS text", "IF(id % 3 = 0, 'a', 'b') AS role", "'FACT' AS level", "1D AS confidence", "array(concat('e', lpad(id % 500, 3, '0'))) AS cited")
    found = why.conclude(rows)
    # array_distinct holds each pair of structs against all others: the square of the statements of a key.
    assert "array_distinct" not in found._jdf.queryExecution().optimizedPlan().toString()
    (one,) = found.collect()
    assert one.statements == 3000 and [(e.name, e.reasons) for e in one.evidence] == [(f"e{k:03d}", "a; b") for k in range(500)]


def test_nothing_gives_no_answers(tables):
    none = {k: v.limit(0) for k, v in tables.items()}
    assert why.symbols_why(*(none[n] for n in ("symbols", "files", "versions", "relations", "commits", "covered"))).isEmpty()
    assert why.commits_why(none["relations"], none["commits"]).isEmpty() and why.work_why(none["relations"], none["commits"]).isEmpty()
