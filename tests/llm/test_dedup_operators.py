"""SimHash linking and suffix dedup against brute force."""

import hashlib
import random
import time

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolith.llm import near_copies as near_module
from chronolith.llm import simhash as simhash_module
from chronolith.llm import suffix_dedup
from chronolith.llm.common import Scratch
from chronolith.llm.components import connected_components
from chronolith.llm.grouping_sort import suffix_array
from chronolith.llm.near_copies import near_copies
from chronolith.llm.simhash import link_fingerprints, near_duplicates, one_of_each, ring_pairs, simhash
from chronolith.llm.suffix_dedup import LENGTH, hot_masks, removed_strings, sorted_masks


def plain_components(items, linked):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def plain_simhash(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_by_hand():
    for text in ("One two", "a b c d É e", "", None, "x\ty\nz", "same same same same same"):
        assert simhash(text.encode() if text is not None else None) == plain_simhash(text)


def test_links_of_fingerprints(spark):
    random.seed(5)
    seeds = [random.getrandbits(64) for _ in range(40)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(6):
            x = s
            for _ in range(random.randint(1, 4)):
                x ^= 1 << random.randrange(64)
            prints.add(x)
    nodes = {i: p for i, p in enumerate(sorted(prints))}
    signed = [(p - 2**64 if p >= 2**63 else p, i) for i, p in nodes.items()]
    edges = link_fingerprints(spark.createDataFrame(signed, "fp long, node long"))
    found = {r.node: r.component for r in connected_components(edges).collect()}
    expected = plain_components(list(nodes), lambda a, b: (nodes[a] ^ nodes[b]).bit_count() <= 2)
    assert {i: found.get(i, i) for i in nodes} == expected


def test_crowded_rings_give_the_same_pairs(monkeypatch):
    random.seed(6)
    base = random.getrandbits(64)
    ring = {base}
    while len(ring) < 400:
        x = base
        for _ in range(random.randint(1, 6)):
            x ^= 1 << random.choice((0, 1, 2, 3, 20, 21, 33, 34, 40))
        ring.add(x)
    ring = np.array(sorted(ring), np.uint64)
    pairs = lambda: {(int(a), int(b)) for x, y in ring_pairs(ring, 2) for a, b in zip(x, y)}
    found = pairs()
    assert len(found) > 1000 and all((int(ring[a]) ^ int(ring[b])).bit_count() <= 2 for a, b in found)
    for limit in (0, 3, 20):
        monkeypatch.setattr(simhash_module, "PROBED_RUN", limit)
        assert pairs() == found


def test_near_duplicates_edge_cases(spark):
    rows = [(5, "A b c d"), (3, "a B c d"), (9, None), (8, ""), (7, "other words here now"), (7, "other words here now"), (None, "a b c d")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    found = sorted(((r.doc_id or 0, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()))
    print_a = f"{plain_simhash('a b c d'):016x}"
    assert found == sorted([(5, print_a, 3), (3, print_a, 3), (0, print_a, 3), (9, "0" * 16, 8), (8, "0" * 16, 8)] + 2 * [(7, f"{plain_simhash('other words here now'):016x}", 7)])
    assert near_duplicates(docs.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in one_of_each(docs).collect()) == [0, 3, 7, 7, 8]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_grouping_sort(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def plain_removal(rows):
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for k in range(len(data) - LENGTH + 1):
            if seen.setdefault(data[k : k + LENGTH], doc) < doc:
                covered[k : k + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, c in zip(data, covered) if not c)
        runs = sum(1 for k in range(len(covered)) if covered[k] and (not k or not covered[k - 1]))
        out[doc] = (len(data), sum(covered), runs, hashlib.sha256(kept).hexdigest())
    return out


def removal(docs, **options):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in removed_strings(docs, **options).collect()}


def test_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 400)
    starts, stops = np.array([0, 3000, 3010]), np.array([3000, 3010, 3100])
    parts = list(suffix_dedup.pieces(starts, stops, np.array([True] * 3)))
    seen = [(doc, base + b + k) for base, _, docs, begins, ends in parts for doc, b, e in zip(docs, begins, ends) for k in range(e - b - LENGTH + 1)]
    assert sorted(seen) == [(0, k) for k in range(3000 - LENGTH + 1)] + [(2, 3010 + k) for k in range(90 - LENGTH + 1)]
    assert all(end - base <= 2 * (400 + LENGTH) for base, end, *_ in parts)


def test_a_long_text_is_searched_in_parts(spark):
    """Passages of another document at and around every cut of a text of several parts."""
    random.seed(9)
    letters = lambda n: bytes(random.choices(b"abcdefgh ", k=n)).decode()
    first, size = letters(3000), suffix_dedup.BATCH_BYTES
    long = list(letters(2 * size + 5000))
    for at in (10, size - 900, size - 40, size + 700, 2 * size - 130, 2 * size + 2000):
        long[at : at + 120] = first[at % 2800 : at % 2800 + 120]
    data = "".join(long)
    known = {first[k : k + LENGTH] for k in range(len(first) - LENGTH + 1)}
    covered = bytearray(len(data))
    for k in range(len(data) - LENGTH + 1):
        if data[k : k + LENGTH] in known:
            covered[k : k + LENGTH] = b"\1" * LENGTH
    docs = spark.createDataFrame([(1, first), (2, data)], "doc_id long, text string")
    found = removal(docs)
    assert found[1][1] == 0 and found[2][1] == sum(covered) >= 6 * 120 and found[2][2] == 6


def test_one_anchor_with_very_many_contexts():
    """Sorting takes what a split leaves at most, in little time; a split by surrounding bytes bounds it."""
    random.seed(4)
    gram = b"the same twenty-four by."
    contexts = [bytes(random.choices(b"abcdef", k=26)) + gram + bytes(random.choices(b"abcdef", k=26)) for _ in range(suffix_dedup.HOT_CONTEXTS)]
    begin = time.process_time()
    suffix_dedup.least_of_strings(contexts, list(range(len(contexts))))
    assert time.process_time() - begin < 10


def test_removed_strings_against_brute_force(spark):
    random.seed(7)
    words = ["alpha", "beta", "ünï", "gamma", "the", "of", "x"]
    passage = " ".join(random.choice(words) for _ in range(60))
    rows = []
    for i in range(60):
        own = " ".join(random.choice(words) + str(random.randrange(50)) for _ in range(40))
        cut = random.randrange(200)
        rows.append((i * 2, own[:150] + passage[cut : cut + random.randrange(30, 150)] + own[150:]))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, ""), (504, "a" * 300), (505, "a" * 120), (506, "short"), (507, "short"), (508, rows[5][1][:-1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_bytes int").repartition(3)
    expected = plain_removal(rows)
    assert removal(docs, with_text=True) == expected
    for hottest in (1, 20_000):  # anchors are split, and grouped if that isn't enough
        assert removal(docs, hot_contexts=1, hottest_contexts=hottest) == expected
    assert removed_strings(docs.limit(0)).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("text_")]


def test_rows_without_doc_id_or_with_the_same(spark):
    text = "this is a text that is long enough to be found again, surely so"
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (6, text)], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.n_removed) for r in removed_strings(docs).collect())
    assert found == [(0, 0), (4, 0), (4, 0), (6, len(text))]


def test_hot_anchors_get_the_same_masks(spark):
    random.seed(3)
    base = bytes(random.randrange(97, 100) for _ in range(70))
    rows = []
    for i in range(40):
        data = bytearray(base)
        data[random.randrange(70)] = 65 + random.randrange(3)
        rows.append((1, bytes(data), i, 0, i, 0))
    rows = list({r[1]: r for r in reversed(rows)}.values())
    table = spark.createDataFrame(rows, "anchor long, context binary, least long, batch long, doc long, start long")
    sort = lambda df: sorted((r.batch, r.doc, r.start, r.mask) for r in df.collect())
    scratch = Scratch(spark, "test-hot")
    assert sort(sorted_masks(table)) == sort(hot_masks(table, scratch)) == sort(hot_masks(table, scratch, often=2)) != []
    assert np.all([r.mask > 0 for r in sorted_masks(table).collect()])


def test_near_copies_against_brute_force(spark):
    random.seed(11)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for g in range(25):
        base = [f"w{random.randrange(4000)}" for _ in range(random.randint(3, 150))] + (passage if g % 2 else [])
        for k in range(8):
            words = list(base)
            for _ in range(k // 2 * len(words) // 100 + (k > 0)):
                words[random.randrange(len(words))] = f"x{random.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (902, rows[9][1].upper()), (903, "a b"), (903, rows[20][1])]

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for _, t in rows]
    similar = lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    parts = plain_components(range(len(rows)), similar)
    expected = sorted((i, min(rows[j][0] for j in parts if parts[j] == parts[k])) for k, (i, _) in enumerate(rows))
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.component_id) for r in near_copies(docs).collect()) == expected
    assert near_copies(docs.limit(0)).count() == 0


def test_fingerprint_chains_find_all_pairs_within_seven_bits(spark):
    random.seed(5)
    fps = {random.getrandbits(64): 2 * i for i in range(300)}
    for f, i in list(fps.items()):
        fps[f ^ sum(1 << b for b in random.sample(range(64), i // 2 % 10))] = i + 1
    nodes = [(f - (f >> 63 << 64), n) for f, n in fps.items()] + [(next(iter(fps)) - (next(iter(fps)) >> 63 << 64), 900)]
    found = {(r.u, r.v) for r in near_module.close_pairs(spark.createDataFrame(nodes, "fp long, node long")).collect()}
    items = list(fps.items())
    want = {(min(i, j), max(i, j)) for k, (f, i) in enumerate(items) for g, j in items[:k] if (f ^ g).bit_count() <= 7}
    assert found == want | {(items[0][1], 900)} and len(want) > 200
    ring = np.sort(np.array([(7 << 60) + (1 << b) + (1 << c) for b in range(40) for c in range(b)], np.uint64))
    pairs = [(int(a), int(b)) for x, y in ring_pairs(ring, 7, 8, 3) for a, b in zip(x, y)]
    assert all((int(ring[a]) ^ int(ring[b])).bit_count() <= 7 for a, b in pairs) and len(pairs) > len(ring)


def test_near_copies_start_from_fingerprints(spark, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    texts = [words, [*words[:150], "other", *words[151:]], words[::-1]]
    monkeypatch.setattr(near_module, "candidate_pairs", lambda *_: spark.createDataFrame([], "u long, v long"))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_copies(docs).collect()) == [(0, 0), (1, 0), (2, 2)]


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    changed = [*words[:40], "other", *words[41:120], "more", *words[121:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(reversed(words)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
