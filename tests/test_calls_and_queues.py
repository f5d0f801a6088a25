"""Call rules, containment by bins, and a queue that breaks off between any two steps."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronolith.operators import call_graph, linking, search
from chronolith.plans.registry import ready
from chronolith.streaming.work_queue import WorkQueue

SYMBOL = "id long, file_id long, name string, qualified_name string, kind string, start_line int, end_line int"
SYMBOLS = [
    (1, 1, "Cart", "Cart", "class", 1, 40), (2, 1, "save", "Cart.save", "method", 2, 9), (3, 1, "load", "Cart.load", "method", 10, 20), (4, 1, "main", "main", "function", 50, 60), (5, 2, "sum", "sum", "function", 1, 5),
    (6, 2, "twin", "twin", "function", 6, 7), (7, 2, "twin", "twin", "function", 8, 9), (8, 3, "vat", "Rates.vat", "method", 1, 3), (9, 3, "Rates", "Rates", "class", 1, 9), (10, 4, "LIMIT", "LIMIT", "variable", 1, 1), (11, 4, "help", "help", "function", 2, 3),
]
CALLS = [
    # line, callee, self, local, via, written -> target, level, confidence, method
    (3, "this.load", True, False, "call", None, (2, 3, "DERIVED", 1.0, "same-class")), (55, "this.load", True, False, "call", None, None), (51, "sum", False, False, "call", None, (4, 5, "DERIVED", 0.9, "import-binding")),
    (52, "ns.sum", False, False, "call", None, None), (53, "ns.twin", False, False, "call", None, None), (11, "main", False, False, "call", None, (3, 4, "DERIVED", 1.0, "same-file")), (54, "Rates.vat", False, False, "call", "r.vat", (4, 8, "INFERRED", 0.54, "qualified-name+stated-type")),
    (12, "Rates.vat", False, True, "call", None, (3, 8, "INFERRED", 0.6, "qualified-name")), (13, "gone", False, True, "call", None, None), (14, "B.vat", False, False, "call", None, (3, 8, "DERIVED", 0.95, "import-binding")),
    (56, "Cart.save", False, False, "reference", None, (4, 2, "INFERRED", 0.8, "same-file+passed-as-value")), (57, "Cart", False, False, "reference", None, None), (4, "sum", False, False, "reference", None, (2, 5, "INFERRED", 0.8, "import-binding+passed-as-value")),
    (58, "main", False, False, "call", None, None), (59, "pkg.run", False, False, "call", None, None), (15, "*", False, False, "call", None, None),
]


def test_call_rules(spark):
    ready(spark)
    symbols = spark.createDataFrame(SYMBOLS, SYMBOL)
    bindings = spark.createDataFrame([(1, "sum", "sum", 0.9, [2]), (1, "ns", "*", 1.0, [2]), (1, "B", "Rates", 1.0, [3]), (1, "pkg", "*", 1.0, [])], "file_id long, local_name string, imported string, confidence double, targets array<long>")
    calls = spark.createDataFrame([(1, *c[:6]) for c in CALLS], "file_id long, line int, callee string, self_receiver boolean, local_head boolean, via string, written string")
    found = {(r.source_id, r.target): (r.source_id, r.target, r.level, round(r.confidence, 9), r.method) for r in call_graph.call_edges(calls, symbols, bindings).collect()}
    want = {c[6][:2]: c[6] for c in CALLS if c[6]}
    want[4, 5] = (4, 5, "DERIVED", 0.9, "import-binding")  # the surer of two sites; ns.sum reaches the same one
    assert {k: v for k, v in found.items() if k != (4, 5)} == {k: v for k, v in want.items() if k != (4, 5)}
    assert found[4, 5][3] == 0.95 and found[4, 5][4] == "import-binding"  # through the module, whose import is surer
    checked = spark.createDataFrame([(1, 52, 2, 2, "sum"), (1, 3, 1, 55, "main"), (1, 70, 4, 2, "help"), (1, 99, 2, 2, "nothing")], "from_file long, line int, to_file long, to_line int, to_name string")
    again = {(r.source_type, r.source_id, r.target): r.method for r in call_graph.call_edges(calls, symbols, bindings, checked).collect()}
    assert again["symbol", 4, 5] == again["symbol", 2, 4] == again["file", 1, 11] == "typescript-checker" and ("symbol", 2, 3) not in again


def test_lines_meet_spans_in_a_long_file(spark):
    n = 100_000
    symbols = spark.range(n // 10).selectExpr("id", "1L AS file_id", "cast(id * 10 + 1 AS int) AS start_line", "cast(id * 10 + 9 AS int) AS end_line").unionByName(spark.createDataFrame([(-1, 1, 1, n)], "id long, file_id long, start_line int, end_line int"))
    calls = spark.range(n).selectExpr("1L AS file_id", "cast(id + 1 AS int) AS line", "'f' AS callee")
    found = search.innermost(calls, symbols)
    wrong = found.where(F.col("caller_id") != F.when(F.col("line") % 10 == 0, -1).otherwise(F.expr("(line - 1) div 10")))
    assert found.count() == n and wrong.isEmpty()


class Broken(Exception):
    pass


def changes(spark, n=40):
    rows = [(i, i // 3, dt.datetime(2026, 1, 1) + dt.timedelta(hours=i // 6)) for i in range(n)] + [(900, None, dt.datetime(2026, 1, 1)), (901, 1, None)]
    return spark.createDataFrame(rows, "id long, commit_id long, at timestamp").repartition(3)


def test_a_queue_goes_on_after_a_break_between_any_two_steps(spark, tmp_path, monkeypatch):
    pending = changes(spark)
    whole = WorkQueue(spark, str(tmp_path / "whole"))
    assert whole.results() is None and whole.run(pending, "at", "commit_id", 7, lambda b: b) == 5
    want = sorted((r.batch, r.id) for r in whole.results().collect())
    assert [i for _, i in want] == list(range(40)) and {b for b, _ in want} == set(range(5))
    sizes = whole.results().groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("commit_id").alias("c")).collect()
    assert {r.n for r in sizes if r.batch < 4} == {9}  # three whole commits reach seven

    queue = WorkQueue(spark, str(tmp_path / "broken"))

    def fail(*_):
        raise Broken

    def half(batch):
        batch.limit(1).write.mode("overwrite").parquet(f"{queue.path}/rows/batch=0")  # part of a batch is left behind
        raise Broken

    for work in (fail, half):  # before and while a batch is written
        with pytest.raises(Broken):
            queue.run(pending, "at", "commit_id", 7, work)
        assert queue.results() is None
    put = WorkQueue._put
    monkeypatch.setattr(WorkQueue, "_put", fail)  # after it is written, before its mark
    with pytest.raises(Broken):
        queue.run(pending, "at", "commit_id", 7, lambda b: b)
    assert queue.mark() is None and queue.results() is None
    monkeypatch.setattr(WorkQueue, "_put", put)
    assert queue.run(pending, "at", "commit_id", 7, lambda b: b, budget=2) == 2 and queue.mark()["number"] == 1
    with pytest.raises(Broken):
        queue.run(pending, "at", "commit_id", 7, fail)
    assert not queue._put(1, {"number": 1})  # another run was first
    assert queue.run(pending, "at", "commit_id", 7, lambda b: b) == 3 and queue.run(pending, "at", "commit_id", 7, lambda b: b) == 0
    assert sorted((r.batch, r.id) for r in queue.results().collect()) == want


def test_batches_that_one_job_writes_are_those_of_single_jobs(spark, tmp_path):
    rnd = random.Random(3)
    groups = [(c, dt.datetime(2026, 1, 1) + dt.timedelta(hours=c // 4), 300 if c == 60 else rnd.choice([1, 1, 2, 3])) for c in range(120)]
    rows = [(c * 100 + i, c, at) for c, at, n in groups for i in range(n)]
    pending = spark.createDataFrame([*rows, (-1, None, groups[0][1]), (-2, 1, None)], "id long, commit_id long, at timestamp").repartition(3)
    want, total, end = [], 0, 0  # last row number of each batch
    for _, _, n in groups:
        total += n
        if total >= end + 7:
            end = total
            want.append(end)
    want += [total] if total > end else []
    queue, calls = WorkQueue(spark, str(tmp_path / "many")), []

    def work(rows):
        calls.append(1)
        return rows.select("id", "batch")

    assert queue.run(pending, "at", "commit_id", 7, work, budget=3, together=16) == 3 and len(calls) == 1
    spark.range(5).write.parquet(f"{queue.path}/rows/batch=3")  # left behind
    assert queue.run(pending, "at", "commit_id", 7, work, together=16) == len(want) - 3
    assert len(calls) <= 2 + len(want) // 8 < len(want) and queue.mark()["number"] == len(want) - 1
    found = {}
    for r in queue.results().collect():
        found.setdefault(r.batch, set()).add(r.id)
    ids = [i for i, _, _ in rows]
    assert found == {k: set(ids[a:b]) for k, (a, b) in enumerate(zip([0, *want], want))}
    assert queue.run(pending, "at", "commit_id", 7, work, together=16) == 0


def test_a_cursor_takes_what_is_newer(spark, tmp_path):
    queue = WorkQueue(spark, str(tmp_path / "cursor"))
    pages = changes(spark, 12)
    assert queue.run(pages, "at", "id", 5, lambda b: b.select("id")) == 3
    later = pages.unionByName(spark.createDataFrame([(77, 9, dt.datetime(2027, 1, 1))], "id long, commit_id long, at timestamp"))
    assert queue.run(later, "at", "id", 5, lambda b: b.select("id")) == 1 and queue.mark()["key"] == 77
    assert sorted(r.id for r in queue.results().collect()) == [*range(12), 77, 901 - 1]


def test_lookups_are_due_after_a_week(spark):
    now = dt.datetime(2026, 3, 10)
    asked = spark.createDataFrame([("A-1", now - dt.timedelta(days=7)), ("A-1", now - dt.timedelta(days=20)), ("A-2", now - dt.timedelta(days=6))], "number string, checked_at timestamp")
    wanted = spark.createDataFrame([("A-1",), ("A-2",), ("A-3",)], "number string")
    due = linking.due_lookups(wanted, asked, spark.createDataFrame([(now,)], "now timestamp"), ["number"])
    assert {tuple(r) for r in due.collect()} == {("A-1", "expired"), ("A-3", "new")}


@pytest.mark.parametrize("seed", [1, 2])
def test_symbols_follow_renames_in_order(spark, seed):
    ready(spark)
    rnd = __import__("random").Random(seed)
    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    symbols = [(i, rnd.randrange(12), day(rnd.randrange(40))) for i in range(25)]
    renames = [(i, rnd.randrange(14), rnd.randrange(14), day(rnd.randrange(40))) for i in range(30)]
    where = {i: f for i, f, _ in symbols}
    since = {i: t for i, _, t in symbols}
    for _, a, b, t in sorted((r for r in renames if r[1] != r[2]), key=lambda r: (r[3], r[0])):
        if not any(where[i] == b and since[i] <= t for i in where):
            for i in where:
                if where[i] == a and since[i] <= t:
                    where[i], since[i] = b, t
    found = search.follow_renames(spark.createDataFrame(symbols, "id long, file_id long, born_at timestamp"), spark.createDataFrame(renames, "rename_id long, from_id long, to_id long, at timestamp"))
    assert {r.id: r.now for r in found.collect()} == where and any(r.now != r.file_id for r in found.collect())
