"""Op 5: SimHash fingerprints linked within a small Hamming distance by the pigeonring principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks, materialise, small_batches, table
from .components import connected_components

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
#: Fingerprints that a linking task looks at together; a larger bucket is taken whole.
LINK_ROWS = 200_000
#: Pairs that are compared at once.
PAIR_ROWS = 2_000_000
#: Fingerprints with the same two first segments whose partners are looked up bit by bit; fewer are compared in pairs.
PROBED_RUN = 4096


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The bits that over half of n hashes have set."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(h: np.ndarray, part: int = 500_000) -> int:
    """SimHash of an array of hashes; zero without any."""
    return majority(sum((bit_counts(h[a : a + part]) for a in range(0, len(h), part)), np.zeros(BITS, np.int64)), len(h))


def simhash(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit k is set if it is set in over half of the shingles' XXH64 values; no words: zero."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    parts = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[w] for w in words]
    ones, n = np.zeros(BITS, np.int64), max(1, len(words) - shingle + 1)
    shingles = zip(*parts)
    for begin in range(0, n, 500_000):
        size = min(500_000, n - begin)
        h = np.fromiter(map(xxh64_intdigest, map(b" ".join, (s for s, _ in zip(shingles, range(size)))) if n > 500_000 else map(b" ".join, shingles), repeat(seed)), np.uint64, size)
        ones += bit_counts(h)
    return majority(ones, n)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            for a, b in chunks(texts, lambda t: len(t or b"")):
                found = np.array([simhash(t, shingle, seed) for t in texts[a:b]], np.uint64)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def chain_budgets(distance: int, segments: int = SEGMENTS) -> list[int]:
    """Largest sum of differences that a chain of 1, 2, ... segments may have: its share of the distance."""
    return [k * distance // segments for k in range(1, segments + 1)]


def chain_masks(distance: int) -> list[int]:
    """All differences within the distance that keep to the chain budgets, the first segment being on top."""
    budgets = chain_budgets(distance)
    masks = []
    for size in range(1, distance + 1):
        for bits in combinations(range(BITS - WIDTH), size):  # the first segment has no difference
            mask = sum(1 << b for b in bits)
            if all((mask >> BITS - k * WIDTH).bit_count() <= budgets[k - 1] for k in range(2, SEGMENTS + 1)):
                masks.append(mask)
    return masks


def ring_pairs(ring: np.ndarray, distance: int, segments: int = SEGMENTS, near: int | None = None, pair_rows: int = PAIR_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (a < b) in a sorted array of rotated fingerprints that pass every chain budget.

    ``ring`` is rotated so that the chain's first segment is on top. A pair within the distance has
    a chain, for some rotation, whose first segment is equal (budget 0), whose first two differ
    by at most their budget, and so on. Partners are looked up by the first two segments: equal, or
    one bit apart in the second; the other budgets prune what is found, and the last is the full check.
    Where very many agree in those, each looks for what the budgets allow instead, so the work is in
    proportion to their number; with ``near``, which is for candidates alone, each is held against so
    many of the rows that follow it there. ``ring`` has no value twice.
    """
    width, budgets = BITS // segments, chain_budgets(distance, segments)
    if budgets[0] != 0 or budgets[1] > 1:
        raise ValueError(f"distance must be below {segments}")
    top = (ring >> np.uint64(BITS - 2 * width)).astype(np.uint64)

    def within(diff: np.ndarray, ok: np.ndarray) -> np.ndarray:
        for k in range(2, segments + 1):
            ok[ok] = popcount(diff[ok] >> np.uint64(BITS - k * width)) <= budgets[k - 1]
        return ok

    first = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if len(ring) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(ring)))
    crowded = np.repeat(sizes > PROBED_RUN, sizes)
    own = np.flatnonzero(crowded)
    if len(own) and near is not None:
        for step in range(1, near + 1):
            a = own[own + step < len(ring)]
            a = a[within(ring[a] ^ ring[a + step], np.ones(len(a), bool))]
            yield a, a + step
    elif len(own):
        for mask in chain_masks(distance):
            wanted = ring[own] ^ np.uint64(mask)
            at = np.minimum(np.searchsorted(ring, wanted), len(ring) - 1)
            ok = (ring[at] == wanted) & ((own < at) | ~crowded[at])
            yield np.minimum(own[ok], at[ok]), np.maximum(own[ok], at[ok])
    probes = [0] + ([1 << bit for bit in range(width)] if budgets[1] else [])
    for flip in probes:
        wanted = top ^ np.uint64(flip)
        lo, hi = np.searchsorted(top, wanted, "left"), np.searchsorted(top, wanted, "right")
        lo = np.maximum(lo, np.arange(1, len(ring) + 1))  # each pair once
        counts = np.where(crowded, 0, np.maximum(hi - lo, 0))
        rows = np.flatnonzero(counts)
        ends = np.cumsum(counts[rows])
        begin = 0
        while begin < len(rows):
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + pair_rows, "right")))
            part = rows[begin:end]
            n = counts[part]
            a = np.repeat(part, n)
            b = np.repeat(lo[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ok = within(ring[a] ^ ring[b], ~crowded[b])
            yield a[ok], b[ok]
            begin = end


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label of each connected part, given more edges."""
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == labels).all():
            return labels
        labels = new


def link_fingerprints(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (u, v) over ``nodes`` (fp long, node long): enough to connect every linked pair.

    Each fingerprint goes to four tasks by the value of each of its 16-bit segments; a task links
    what shares the segment and emits one edge per fingerprint to the smallest of its part, so a
    group of n near copies makes n edges, not n squared.
    """

    def link(data: pa.Table) -> pa.RecordBatch | None:
        chain = data["bucket"].to_numpy() >> WIDTH
        found = [link_chain(data.filter(pa.array(chain == c))) for c in np.unique(chain)]
        edges = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], ["u", "v"]) if edges.size else None

    def link_chain(data: pa.Table) -> np.ndarray:
        ring, node = data["ring"].to_numpy().view(np.uint64), data["node"].to_numpy()
        order = np.argsort(ring, kind="stable")
        ring, node = ring[order], node[order]
        labels = np.arange(len(ring))
        for a, b in ring_pairs(ring, distance):
            fresh = labels[a] != labels[b]
            if fresh.any():
                labels = merge_labels(labels, a[fresh], b[fresh])
        least = np.full(len(ring), np.iinfo(np.int64).max)
        np.minimum.at(least, labels, node)
        root = least[labels]
        linked = root != node
        return np.stack([node[linked], root[linked]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= LINK_ROWS:
                data = pa.Table.from_batches(held)
                key = data["bucket"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
                if cut and (found := link(data.slice(0, cut))) is not None:
                    yield found
                held, rows = data.slice(cut).combine_chunks().to_batches(), data.num_rows - cut
        if rows and (found := link(pa.Table.from_batches(held))) is not None:
            yield found

    rotations = [
        F.struct(
            F.lit(k).alias("chain"),
            (F.shiftleft("fp", WIDTH * k).bitwiseOR(F.shiftrightunsigned("fp", BITS - WIDTH * k)) if k else F.col("fp")).alias("ring"),
        )
        for k in range(SEGMENTS)
    ]
    spread = nodes.select("node", F.explode(F.array(*rotations)).alias("r")).select("node", "r.ring", "r.chain")
    bucket = F.col("chain") * (1 << WIDTH) + F.shiftrightunsigned("ring", BITS - WIDTH)
    spread = spread.select("node", "ring", bucket.cast("long").alias("bucket"))
    return spread.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links).

    Texts are lower-cased (A-Z only) and cut at ASCII white space; fingerprints link if at most
    ``distance`` bits (0 to 3) differ. Equal fingerprints are one node, so a group of exact copies
    of any size is one row in the linking step. Null and wordless texts have fingerprint zero and
    link like any other. One row for each input row, repeated rows included; rows without a doc_id
    take no part in links and have their fingerprint's component, if any other row gives it one.
    Other columns are ignored. An empty table gives no rows. The result is written once; what was
    written on the way is removed.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    marked = scratch.write(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("node"))
    edges = link_fingerprints(nodes.where("node is not null"), distance)
    labels = connected_components(edges, scratch.write)
    named = nodes.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    found = materialise(marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "near-duplicates-found")
    scratch.clear()
    return found


def one_of_each(docs: DataFrame, groups: DataFrame | None = None, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group of near copies.

    ``groups`` has doc_id and component_id; without it they are the ``near_duplicates``. Rows that
    repeat a doc_id stay or go together; rows without a doc_id stay.
    """
    groups = near_duplicates(docs, **options) if groups is None else groups
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
