"""Symbols tracked over a stream: one batch, many, out of order, and again."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from chronolith.plans.registry import ready
from chronolith.streaming import ingest, symbol_state

VERSION = "file_id long, symbol_id long, commit_id long, committed_at timestamp, content_hash string"


def versions(n=300):
    rnd = random.Random(4)
    rows = []
    for _ in range(n):
        file = 1 if rnd.random() < 0.4 else rnd.randrange(2, 20)  # one file holds much of all
        commit = rnd.randrange(60)
        rows.append((file, file * 100 + rnd.randrange(6), commit, dt.datetime(2026, 1, 1) + dt.timedelta(hours=commit // 2), rnd.choice("abc")))
    return rows + [(None, 1, 1, dt.datetime(2026, 1, 1), "a"), (1, None, 1, dt.datetime(2026, 1, 1), "a"), (1, 100, None, None, "a")]


def expected(rows):
    by = defaultdict(dict)
    for file, symbol, commit, at, digest in rows:
        if None not in (file, symbol, commit, at, digest):
            by[file, symbol][commit] = max(by[file, symbol].get(commit, (at, "")), (at, digest))
    out = set()
    for key, found in by.items():
        ordered = sorted((at, commit, digest) for commit, (at, digest) in found.items())
        hashes = [d for _, _, d in ordered]
        out.add((*key, ordered[0][1], ordered[-1][1], hashes[-1], len(ordered), 1 + sum(a != b for a, b in zip(hashes, hashes[1:]))))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_symbols_are_the_same_in_any_batches_and_order(spark, tmp_path, batches):
    ready(spark)
    rows = versions()
    random.Random(batches).shuffle(rows)
    source, path = str(tmp_path / "in"), str(tmp_path / "state")
    step = -(-len(rows) // batches)
    for begin in range(0, len(rows), step):
        spark.createDataFrame(rows[begin : begin + step], VERSION).coalesce(1).write.mode("append").parquet(source)
    found = symbol_state.track_symbols(ingest.stream_of(spark, source, 1), path)
    assert {tuple(r) for r in found.collect()} == expected(rows) and found.count() == len(expected(rows))
    if batches > 1:  # repeats change nothing, later versions go on from the state
        more = [(1, 100, 99, dt.datetime(2027, 1, 1), "z"), *rows[:40]]
        spark.createDataFrame(more, VERSION).coalesce(1).write.mode("append").parquet(source)
        found = symbol_state.track_symbols(ingest.stream_of(spark, source, 1), path)
        assert {tuple(r) for r in found.collect()} == expected(rows + more)


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(symbol_state.PROVIDER, None)
    with pytest.raises(ZeroDivisionError):
        symbol_state.run(spark, lambda: 1 / 0)
    assert spark.conf.get(symbol_state.PROVIDER, None) == before


def test_versions_of_one_symbol_merge():
    once = symbol_state.merged(None, [(5, 2, "b"), (1, 1, "a")])
    assert once == ([1, 5], [1, 2], ["a", "b"])
    assert symbol_state.merged(once, [(5, 2, "b"), (5, 2, "a"), (3, 7, "c")]) == ([1, 3, 5], [1, 7, 2], ["a", "c", "b"])


def test_present_rows_follow_the_rule_of_merged_versions(spark):
    rnd = random.Random(8)
    rows = [(k, 7, [(rnd.randrange(4), rnd.randrange(5), rnd.choice("ab")) for _ in range(rnd.randint(1, 9))]) for k in range(60)]
    rows = [(f, s, list(set(v))) for f, s, v in rows]
    found = symbol_state.present_rows(spark.createDataFrame(rows, "file_id long, symbol_id long, found array<struct<commit_id: long, at: long, content_hash: string>>"))
    want = set()
    for file, symbol, versions in rows:
        _, commits, hashes = symbol_state.merged(None, [(t, c, h) for c, t, h in versions])
        want.add((file, symbol, commits[0], commits[-1], hashes[-1], len(commits), 1 + sum(a != b for a, b in zip(hashes, hashes[1:]))))
    assert {tuple(r) for r in found.collect()} == want
