"""Packing, token files and token counts against the tokenizers library itself."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronolith.llm.common import fresh_path
from pyspark.sql import functions as F

from chronolith.llm.counts import BPE, WORDS, TokenRollup, deletes, inserts, moves, revisions, roll_up
from chronolith.llm.packing import CapacityTree, first_fit_decreasing, pack_documents
from chronolith.llm.token_files import BLOCK, SegmentReader, encode_segment, read_token_files, write_token_files
from chronolith.llm.tokens import WordEncoder, vocabulary

TEXTS = ["Don't STOP!! it's", None, "", "x0y 10 % ##$ İstanbul ΣΑΣ. <|endoftext|> café", "word, " * 3000, "Same text here.", "Same text here.", "\t\n  "]


def ids_of(text):
    return Tokenizer.from_file(vocabulary()).encode(text or "", add_special_tokens=False).ids


def documents(spark, texts=TEXTS):
    rows = [(i * 3, t, "en", "s" if i % 2 else None, len(t or ""), "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, start int")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_word_encoder_equals_the_library(texts):
    encoder = WordEncoder(vocabulary(), limit=20)
    library = Tokenizer.from_file(vocabulary())
    clean = [t.encode("utf-8", "ignore").decode() for t in texts]
    for _ in range(2):
        got = encoder.encode([t.encode() for t in clean])
        assert got == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in clean]


@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing_equals_a_plain_loop(sizes):
    bins, offsets = first_fit_decreasing(np.array(sizes, np.int64), 50)
    free: list[int] = []
    expected = {}
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((k for k, f in enumerate(free) if f >= sizes[item]), len(free))
        if b == len(free):
            free.append(50)
        expected[item] = (b, 50 - free[b])
        free[b] -= sizes[item]
    assert {i: (int(b), int(o)) for i, (b, o) in enumerate(zip(bins, offsets))} == expected


def test_capacity_tree_takes_the_first_bin_with_room():
    tree = CapacityTree(3, 10)
    assert [tree.first_fit(s) for s in (6, 6, 4, 5, 4)] == [0, 1, 0, 2, 1]


def test_packing_keeps_every_id_once(spark):
    rows = pack_documents(documents(spark), with_ids=True, group_docs=3).collect()
    ids = {i * 3: [*ids_of(t), 2] for i, t in enumerate(TEXTS)}
    pieces: dict[int, list] = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert np.frombuffer(r.ids, "<u4").tolist() == part and r.ids_crc32 == zlib.crc32(r.ids)
        assert r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for doc, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[doc])
    assert set(pieces) == set(ids)
    for _, group in __import__("itertools").groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_packing_of_an_empty_table_and_null_ids(spark):
    empty = documents(spark).limit(0)
    assert pack_documents(empty).count() == 0
    nameless = spark.createDataFrame([(None, "a b"), (2**60 + 1, "c")], "doc_id long, text string")
    assert {r.doc_id for r in pack_documents(nameless).collect()} == {None, 2**60 + 1}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50_000), st.integers(0, 2**32 - 1)), max_size=3 * BLOCK))
def test_segment_round_trip(values):
    array = np.array(values, "<u4")
    reader = SegmentReader(encode_segment([None, 5], [len(values), 0], array))
    assert (reader.read() == array).all() and reader.doc_ids == [None, 5]
    assert (reader.read(3, 700) == array[3:700]).all()


def test_token_files_round_trip(spark):
    path = fresh_path(spark, "test-token-files")
    write_token_files(documents(spark).repartition(3), path)
    rows = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for i, (r, t) in enumerate(zip(rows, TEXTS)):
        ids = [*ids_of(t), 1]
        assert (r.doc_id, r.start, r.n_tokens) == (i * 3, at, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.ids_crc32 == zlib.crc32(r.ids)
        at += len(ids)
    assert len(rows) == len(TEXTS)


def test_token_files_of_an_empty_table(spark):
    path = fresh_path(spark, "test-no-token-files")
    write_token_files(documents(spark).limit(0), path)
    assert read_token_files(spark, path).count() == 0


def test_rollup_equals_a_recount(spark):
    found = {(r.source, r.tokenizer): (r.n_docs, r.n_tokens) for r in roll_up(documents(spark), fresh_path(spark, "test-rollup")).collect()}
    expected = Counter()
    docs = Counter()
    for i, t in enumerate(TEXTS):
        if t is not None:
            source = "s" if i % 2 else None
            docs[source] += 1
            expected[source, WORDS] += len(t.split(None)) if t.strip() else 0
            expected[source, BPE] += len(ids_of(t))
    assert found == {(s, k): (docs[s], expected[s, k]) for s in docs for k in (WORDS, BPE)}


def test_batches_commit_once(spark):
    rollup = TokenRollup(spark, fresh_path(spark, "test-commits"))
    rows = spark.createDataFrame([("a", "en", 5), ("a", "en", 7)], "source string, lang string, n long")
    deltas = inserts(rows, WORDS, rows["n"])
    assert rollup.totals().count() == 0
    assert rollup.commit("b1", deltas) and not rollup.commit("b1", deltas)
    assert rollup.commit("b2", revisions(rows, WORDS, rows["n"], rows["n"] + 1))
    assert [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()] == [(2, 14)]
    with pytest.raises(ValueError):
        rollup.commit("../x", deltas)


def test_totals_are_kept_in_a_snapshot(spark):
    rollup = TokenRollup(spark, fresh_path(spark, "test-snapshots"))
    rows = spark.createDataFrame([("a", "en", 5, "x"), (None, "en", 7, "y")], "source string, lang string, tokens long, docs string")
    assert not rollup.compact()
    assert rollup.commit("b1", inserts(rows, WORDS, rows["tokens"])) and rollup.compact() and not rollup.compact()
    moved = rows.where("source = 'a'")
    assert rollup.commit("b2", moves(moved, WORDS, (F.col("source"), F.col("lang"), F.col("tokens")), (F.lit("b"), F.lit("fr"), F.col("tokens") + 3)))
    expected = [("b", "fr", 1, 8), (None, "en", 1, 7)]
    key = lambda r: (r[0] or "", r)
    assert sorted(summed_any(rollup), key=key) == sorted(expected, key=key)
    assert rollup.compact() and not rollup.commit("b1", inserts(rows, WORDS, rows["tokens"]))
    assert rollup.vacuum() == 3 and sorted(summed_any(rollup), key=key) == sorted(expected, key=key)
    assert rollup.commit("b3", deletes(rows.where("source IS NULL"), WORDS, F.col("tokens")))
    assert summed_any(rollup) == [("b", "fr", 1, 8)]


def summed_any(rollup):
    return [(r.source, r.lang, r.n_docs, r.n_tokens) for r in rollup.totals().collect()]


def test_rivals_and_failed_attempts_count_once(spark, monkeypatch):
    path = fresh_path(spark, "test-rivals")
    first, second = TokenRollup(spark, path), TokenRollup(spark, path)
    rows = spark.createDataFrame([("a", "en", 5)], "source string, lang string, n long")
    deltas = inserts(rows, WORDS, rows["n"])
    deltas.write.parquet(f"{path}/data/b1-left-by-a-failure")
    monkeypatch.setattr(second, "batches", list)  # has looked before the first committed
    assert first.commit("b1", deltas) and not second.commit("b1", deltas)
    assert summed_any(first) == [("a", "en", 1, 5)]
    broken = deltas.withColumn("tokens", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        first.commit("b2", broken)
    assert first.batches() == ["b1"] and first.commit("b2", deltas) and summed_any(first) == [("a", "en", 2, 10)]
    number = first._state()[0]
    assert first.compact() and not first._mark(f"snapshots/{number:012d}", ["data/other"])
    assert summed_any(first) == [("a", "en", 2, 10)]
