"""Token alignment, pair encoding and vector codes against brute force and the libraries."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

import public_tokenizers
from chronolith.llm.alignment import GROUP_CHUNKS, JOIN_LINKS, align_chunk, align_corpus, op11_token_alignment, tokenizer_pair
from chronolith.llm.bpe import PairEncoder, decode_documents, encode_documents, op12_bpe_round_trip
from chronolith.llm.codes import compress_vectors, digest, error_by_label, nearest, op13_vector_codes, sequency_matrix
from chronolith.llm.common import shared_dir

FOLDER = "/root/testdata/sf0.001"
BYTE, PIECE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = [
    None, "", " ", "  ", "a", "It's <|endoftext|> plain <s> text <0x41>", "U+2581 ▁ is no space", "漢字かな交じり文 한국어 ทดสอบ", "\U0001f600‍\U0001f468 é é \x00\x85 ",
    "tabs\t\tand\r\n\r\nlines \n", "=" * 500 + "-" * 333, "same text", "same text", " trailing  ", "a" * 3000, " " * 25_000 + "x",
]


def documents(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "clash", 1, 2) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, chunk int, n_tokens int").repartition(3)


# Op 11


def tokens_of(text):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    table = {chr(c): i for i, c in enumerate(byte_order())}

    def tokens(text):
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        first = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in ids]
        second = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (first, second) if b"".join(x for _, x in first) == whole == b"".join(x for _, x in second) else ([], [])

    return [tokens(t) for t in text]


def byte_order():
    """Code points of the 256 bytes' characters, by the published rule."""
    found, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            found.append(b)
        else:
            found.append(extra)
            extra += 1
    return found


def brute_alignment(texts):
    groups = []
    for first, second in tokens_of(texts):
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (first, second)]
        common = sorted(ends[0] & ends[1])
        parts = [([], []) for _ in common]
        for k, side in enumerate((first, second)):
            at = g = 0
            for i, x in side:
                at += len(x)
                parts[g][k].append(i)
                g += at == common[g]
        groups.append(parts)
    counts = Counter(p for parts in groups for p in {(a, b) for x, y in parts for a in x for b in y})
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    rows = []
    for parts in groups:
        links = [(a, b) for x, y in parts for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in parts)
        rows.append((
            sum(len(x) for x, _ in parts), sum(len(y) for _, y in parts), len(parts), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if parts else "",
        ))
    return rows, counts


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_brute_force(spark):
    given = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()]
    texts = ODD + given
    scored, counts = align_corpus(documents(spark, texts))
    want, pairs = brute_alignment(texts)
    got = {r["doc_id"]: tuple(r[c] for c in ALIGNED) for r in scored.collect()}
    assert got == dict(enumerate(want))
    assert {(r["a"], r["b"]): r["documents"] for r in counts.collect()} == pairs
    assert got[6] == (0, 0, 0, 0, 0, 0, "")  # U+2581 in a text


def test_alignment_of_repeated_null_ids_and_no_rows(spark):
    scored, _ = align_corpus(documents(spark, ["one two", "one two", None, "x"], [7, 7, None, None]))
    want, _ = brute_alignment(["one two", "one two", None, "x"])
    assert Counter((r["doc_id"], *(r[c] for c in ALIGNED)) for r in scored.collect()) == Counter((i, *w) for i, w in zip([7, 7, None, None], want))
    assert align_corpus(documents(spark, []))[0].count() == 0


def test_alignment_of_long_texts_and_groups():
    tokenizers = tokenizer_pair(BYTE, PIECE)
    text = ("wörter  und 漢字 " * 40_000)[:500_001] + " " * 3  # cut for the piece model, more than once
    assert tokenizers.second([text]) == tokenizers.pieces.encode([text])
    assert tokenizers.second(["ab " * 66_667 + " "]) == tokenizers.pieces.encode(["ab " * 66_667 + " "])
    counts, links = align_chunk(["x" * 1_000_001 + " end", None, text], tokenizers)
    assert sum(links["times"].to_pylist()) == counts["n_links"].sum()


def test_links_of_one_group_are_joined_in_stretches(monkeypatch):
    import chronolith.llm.alignment as alignment

    tokenizers = tokenizer_pair(BYTE, PIECE)
    texts = [t for t in ODD if t] * 3
    whole = align_chunk(texts, tokenizers)[1].sort_by([("document", "ascending"), ("pair", "ascending")])
    monkeypatch.setattr(alignment, "JOIN_LINKS", 3)
    assert JOIN_LINKS > 3 and align_chunk(texts, tokenizers)[1].sort_by([("document", "ascending"), ("pair", "ascending")]) == whole


def test_a_task_holds_a_few_chunks_however_many_it_has(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    records, folder = spark.conf.get(key), Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("alignment-*"))
    spark.conf.set(key, "1")
    try:
        scored, _ = align_corpus(documents(spark, [f"text {k}" for k in range(7)]).coalesce(1))
        assert scored.count() == 7
    finally:
        spark.conf.set(key, records)
    files = [pq.ParquetFile(f).metadata for made in set(folder.glob("alignment-*")) - before for f in made.glob("*-chunks/*.parquet")]
    assert sum(f.num_rows for f in files) == 7
    assert all(f.row_group(k).num_rows <= GROUP_CHUNKS for f in files for k in range(f.num_row_groups))


def test_alignment_query_has_a_row_for_each_document(spark):
    found = op11_token_alignment(spark, FOLDER)
    assert found.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


# Op 12


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def round_trip(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_pair_encoding_equals_the_library(library):
    rnd = random.Random(3)
    letters = "ab'sdtKſ1٣̧́̃éñ  　漢한\U0001f600!-#_İΣ<|>xy\n\t "
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randint(1, 0x2FFF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(rnd.randint(1, 30))) for _ in range(1500)]
    texts += ["<|endoftext|>x<|startoftext|><|endoftext|> <|ENDOFTEXT|>", "a" * 20_001, "ha" * 1500, "漢字かな" * 2000 + "z", "", "".join(rnd.choice("abcdefghij") for _ in range(9000))]
    encoder = PairEncoder(WORD, limit=500)  # generations of known words turn over
    for begin in range(0, len(texts), 200):
        part = texts[begin : begin + 200]
        ids = encoder.encode([t.encode() for t in part])
        for text, i, d in zip(part, ids, encoder.decode(ids)):
            want, decoded = round_trip(library, text)
            assert np.frombuffer(i, "<u4").tolist() == want and d.decode() == decoded, text[:80]


def test_long_pieces_take_the_same_rounds(monkeypatch):
    import chronolith.llm.bpe as bpe

    words = ["".join(random.Random(k).choice("aaabcdé漢") for _ in range(400)).encode() for k in range(20)]
    short = PairEncoder(WORD).encode(words)
    monkeypatch.setattr(bpe, "LONG_PIECE", 1)
    assert PairEncoder(WORD).encode(words) == short


def test_round_trip_query_equals_the_library(spark, library):
    rows = {r["doc_id"]: r for r in op12_bpe_round_trip(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        ids, decoded = round_trip(library, doc["text"])
        r = rows[doc["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_round_trip_of_odd_rows(spark, library):
    ids = [None, 5, 5, *range(10, 7 + len(ODD))]
    found = decode_documents(encode_documents(documents(spark, ODD, ids))).collect()
    want = Counter()
    for i, t in zip(ids, ODD):
        found_ids, decoded = round_trip(library, t)
        want[i, len(found_ids), decoded] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded"].decode()) for r in found) == want
    assert encode_documents(documents(spark, [])).count() == 0


# Op 13


def brute_codes(rows, entries=16, rounds=6, parts=8):
    kept = [(i, label, [math.floor(4096 * x) for x in v]) for i, v, label in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    step = len(kept[0][2]) // parts
    cut = [[v[p * step : (p + 1) * step] for p in range(parts)] for _, _, v in kept]
    order = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (kept[k][0], kept[k][2]))[:entries]
    books = [[list(cut[k][p]) for k in order] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], c)), e) for e, c in enumerate(books[p])) for p in range(parts)] for x in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[p] for x, f in zip(cut, found) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    errors = Counter()
    final = [(i, label, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for (i, label, _), f in zip(kept, assign())]
    for _, label, _, error in final:
        errors[label] += error
    return Counter((i, code, error, errors[label]) for i, label, code, error in final), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def coded_rows(frame):
    return Counter((r["vec_id"], bytes(r["code"]).hex(), r["error"], r["label_error"]) for r in frame.collect())


@pytest.mark.parametrize("width,scale", [(8, 1.0), (24, 1.0), (40, 1e4)])
def test_codes_equal_brute_force(spark, width, scale):
    rng = np.random.default_rng(width)
    vectors = [(rng.normal(size=width) * scale).tolist() for _ in range(90)]
    rows = [(int(k), v, None if k % 7 == 0 else k % 3) for k, v in enumerate(vectors)]
    rows += [(90, vectors[3], 1), (3, vectors[3], 1), (3, vectors[4], 2), (None, vectors[5], 0), (91, None, 1), (92, [], 1), (93, [None, *vectors[0][1:]], 1), (94, [math.nan, *vectors[0][1:]], 1), (95, [math.inf, *vectors[0][1:]], 1), (-4, [0.0] * width, 2), (96, [0.0] * width, 2)]
    frame = spark.createDataFrame([(*r, "clash", 9) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)
    coded, books = compress_vectors(frame)
    want, codebooks = brute_codes(rows)
    assert digest(books) == codebooks
    assert coded_rows(error_by_label(coded)) == want


def test_codes_of_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    one = spark.createDataFrame([(5, [1.0] * 8, None), (6, [1.0] * 8, None)], schema)
    coded, books = compress_vectors(one)
    assert coded_rows(error_by_label(coded)) == Counter({(5, "00" * 8, 0, 0): 1, (6, "00" * 8, 0, 0): 1}) and len(books[0]) == 2
    for rows in ([], [(1, None, 1)], [(None, [1.0] * 8, 1)]):
        coded, books = compress_vectors(spark.createDataFrame(rows, schema))
        assert error_by_label(coded).count() == 0 and not books[0]
    with pytest.raises(ValueError, match="one length"):
        compress_vectors(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], schema))


def test_label_sums_over_salts_are_the_same(spark, monkeypatch):
    import chronolith.llm.codes as codes

    frame = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    coded, _ = compress_vectors(frame)
    few = coded_rows(error_by_label(coded))
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 1)
    assert coded_rows(error_by_label(coded)) == few


def test_nearest_entries_are_exact_at_any_size():
    rng = np.random.default_rng(2)
    for width in (1, 3, 8):
        for low, high in ((-2, 3), (-5000, 5000), (-(2**40), 2**40), (-(2**62), 2**62)):
            values, entries = rng.integers(low, high, (120, width)), rng.integers(low, high, (16, width))
            entries[9] = entries[2]
            values[0] = entries[9]
            owner, distance = nearest(values, entries)
            want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(entries)) for x in values]
            assert list(zip(map(int, distance), owner.tolist())) == want
    rows = sequency_matrix(8)
    assert (np.diff(rows, axis=1) != 0).sum(axis=1).tolist() == list(range(8)) and (rows @ rows.T == 8 * np.eye(8)).all()


def test_codes_query_covers_its_table(spark):
    found = op13_vector_codes(spark, FOLDER)
    assert found.count() == spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()
    assert found.select("codebooks_sha256").distinct().count() == 1
