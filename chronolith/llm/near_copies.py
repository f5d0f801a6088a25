"""Near copies by exact Jaccard similarity of word shingles: SimHash chains first, then prefix, length, position and bitmap filters; the texts decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks, materialise, small_batches
from .components import connected_components
from .simhash import BITS, LINK_ROWS, fingerprint, popcount, ring_pairs

#: Similarity of 4/5, kept as whole numbers so that the limit itself is met exactly.
SHINGLE, SIMILAR, OF = 5, 4, 5
#: Bits by which fingerprints of likely near copies differ at most, and the segments of their chains.
DISTANCE, SEGMENTS = 7, 8
#: Documents that tell which shingles are common, and common shingles that are kept. They only set the order.
ORDER_DOCS, ORDER_SHINGLES = 20_000, 200_000
#: Sets with copies whose copies are left out before anything is shuffled (the largest groups; others meet in their buckets).
COPIED_SETS = 1_000_000
#: Rows of ids that are broadcast at most, so that the texts they pick stay where they are; more are joined by a shuffle.
SENT_IDS = 1_000_000
#: Fingerprints that follow one in a crowded run and are held against it.
NEAR = 32
#: Partners of larger components that a set is given in a bucket in a round, and rounds at most. All pairs that are left follow, so they change speed, not results.
TRIED, ROUNDS = 4, 1
#: Longs of a set's parity bitmap; 256 bits are full at some 580 shingles and tell nothing then, 512 at twice as many.
BITMAP = 8
MAPS = [f"b{i}" for i in range(BITMAP)]
#: Pairs that a task holds against each other at a time; some ten numbers each.
PAIR_ROWS = 500_000
#: Least bits of a set's wide parity map.
WIDE = 512


def shingle_set(text: bytes | None, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 values of a text's shingles; a shorter text is one shingle, no words give none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    parts = zip(*[words[i:] for i in range(shingle)]) if len(words) >= shingle else [words]
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(s), seed) for s in parts), np.uint64))


def texts_of(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id is not null")


def sets_of_batch(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """doc_ids, nodes (64 bits of the set's digest; copies have the same) and sets of a batch of texts, in small parts."""
    from xxhash import xxh3_64_intdigest

    ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
    for a, b in chunks(texts, lambda t: len(t or b"")):
        sets = [shingle_set(t, shingle).tobytes() for t in texts[a:b]]
        yield ids[a:b], np.array([xxh3_64_intdigest(s) for s in sets], np.uint64).view(np.int64), sets


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """doc_id, node, SimHash fingerprint, number of shingles, bitmap and wide map of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, nodes, sets in sets_of_batch(batch, shingle):
                sizes, wide = np.array([len(d) // 8 for d in sets], np.int64), [wide_map(d) for d in sets]
                fps = np.array([fingerprint(np.frombuffer(d, np.uint64)) for d in sets], np.uint64).view(np.int64)
                columns = [ids, nodes, fps, sizes, *(np.ascontiguousarray(c) for c in bitmaps(sets).T)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(wide, pa.binary())], names)

    names = ["doc_id", "node", "fp", "n", *MAPS, "wide"]
    return texts.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'wide' else 'long'}" for c in names))


def bitmaps(sets: list[bytes]) -> np.ndarray:
    """BITMAP longs a set: how many of its shingles fall on each bit, odd or even."""
    last = np.uint64(64 * BITMAP - 1)
    found = [np.packbits(np.bincount((np.frombuffer(d, np.uint64) & last).astype(np.int64), minlength=64 * BITMAP) & 1).view(np.int64) for d in sets]
    return np.array(found, np.int64).reshape(len(sets), BITMAP)


def wide_map(data: bytes) -> bytes:
    """Parity map of two to four bits a shingle: a power of two, so that a wider one folds to a narrower one."""
    h = np.frombuffer(data, np.uint64) >> np.uint64(8)
    width = max(WIDE, 1 << (2 * len(h)).bit_length())
    return np.packbits(np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def least_different(x: bytes, y: bytes) -> int:
    """Shingles that two sets surely don't share, by their wide maps."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(popcount(a ^ b).sum())


def sent(ids: DataFrame) -> DataFrame:
    """Distinct ids, broadcast if they are few."""
    ids = ids.select("doc_id").distinct()
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def packed_texts(wanted: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """node and compressed text of the ``wanted`` rows (doc_id, node): less to move than the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            begin = 0
            for ids, nodes, _ in sets_of_batch(batch, shingle):
                part = batch.column(1).slice(begin, len(ids)).to_pylist()
                begin += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(nodes), pa.array([pack.compress(t or b"") for t in part], pa.binary())], ["doc_id", "node", "data"])

    some = texts.join(sent(wanted), "doc_id", "left_semi").mapInArrow(run, "doc_id long, node long, data binary")
    return some.join(wanted, ["doc_id", "node"], "left_semi").groupBy("node").agg(F.first("data").alias("data"))


def common_shingles(owners: DataFrame, texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sampled sets share, and in how many; sorted by value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets in sets_of_batch(batch, shingle):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(sets), np.int64))], ["h"])

    chosen = owners.select("doc_id", "node").orderBy(F.xxhash64("node"), "node").limit(ORDER_DOCS)
    shared = texts.join(sent(chosen), "doc_id", "left_semi").mapInArrow(run, "h long").groupBy("h").count().where("count > 2")
    rows = shared.orderBy(F.desc("count"), "h").limit(ORDER_SHINGLES).toPandas()
    values, counts = rows["h"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.int64)
    order = np.argsort(values)
    return values[order], counts[order]


def least_common(data: bytes, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set's prefix: similar sets share at least one of these, whatever the order, if all sets use the same."""
    h = np.frombuffer(data, np.uint64)
    if len(values):
        at = np.minimum(np.searchsorted(values, h), len(values) - 1)
        seen = np.where(values[at] == h, counts[at], 0)
        if seen.any():
            h = h[np.argsort(seen, kind="stable")]
    return h[: len(h) + SIMILAR * len(h) // -OF + 1] if len(h) else h


def prefix_entries(owners: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """key, node and size (the set's, times 2^32, plus the place of the key) of each prefix shingle that two sets or more have."""
    values, counts = common_shingles(owners, texts, shingle)
    copied = owners.where("copies > 1").orderBy(F.desc("copies"), "node").limit(COPIED_SETS).select("node", "doc_id").toPandas().sort_values("node")
    copied, owner = copied["node"].to_numpy(np.int64), copied["doc_id"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, nodes, datas in sets_of_batch(batch, shingle):
                keep = np.array([len(d) > 0 for d in datas])
                if len(copied):
                    at = np.minimum(np.searchsorted(copied, nodes), len(copied) - 1)
                    keep &= (copied[at] != nodes) | (owner[at] == ids)
                if not keep.any():
                    continue
                nodes, datas = nodes[keep], [d for d, k in zip(datas, keep) if k]
                heads = [least_common(d, values, counts) for d in datas]
                sizes = np.array([len(x) for x in heads])
                places = np.concatenate([np.arange(s) for s in sizes])
                columns = [np.concatenate(heads).view(np.int64), np.repeat(nodes, sizes), (np.repeat(np.array([len(d) // 8 for d in datas], np.int64), sizes) << 32) + places]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["key", "node", "size"])

    def shared(data: pa.Table) -> pa.RecordBatch | None:
        data = data.sort_by([("key", "ascending"), ("node", "ascending")])
        key, node = data["key"].to_numpy(), data["node"].to_numpy()
        data = data.filter(pa.array(np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]))
        key = data["key"].to_numpy()
        same = key[1:] == key[:-1]
        data = data.filter(pa.array(np.r_[False, same] | np.r_[same, False]))
        return data.combine_chunks().to_batches()[0] if data.num_rows else None

    schema = "key long, node long, size long"
    return by_bucket(texts.mapInArrow(run, schema), shared, schema)


def by_bucket(entries: DataFrame, work, schema: str, *sides: DataFrame) -> DataFrame:
    """``work`` done on tables of whole buckets (rows of one key).

    ``sides`` add columns by node: after the shuffle where they are few enough to be sent to all
    tasks, so that they needn't travel with every entry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= LINK_ROWS:
                data = pa.Table.from_batches(held)
                key = data["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
                if cut and (found := work(data.slice(0, cut))) is not None:
                    yield found
                held, rows = data.slice(cut).combine_chunks().to_batches(), data.num_rows - cut
        if rows and (found := work(pa.Table.from_batches(held))) is not None:
            yield found

    few = [s.count() <= SENT_IDS for s in sides]
    for side in (s for s, f in zip(sides, few) if not f):
        entries = entries.join(side, "node", "left")
    entries = entries.repartition("key")
    for side in (s for s, f in zip(sides, few) if f):
        entries = entries.join(F.broadcast(side), "node", "left")
    return entries.sortWithinPartitions("key").mapInArrow(run, schema)


def _ranges(first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (a, b) with b in first[a] to end[a], about PAIR_ROWS at a time."""
    counts = np.maximum(end - first, 0)
    rows = np.flatnonzero(counts)
    sums = np.cumsum(counts[rows])
    begin = 0
    while begin < len(rows):
        base = sums[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(sums, base + PAIR_ROWS, "right")))
        part = rows[begin:stop]
        m = counts[part]
        yield np.repeat(part, m), np.repeat(first[part] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        begin = stop


def _bounds(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the run of equal values begins and ends that each row is in."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(new))
    return np.repeat(begins, ends - begins), np.repeat(ends, ends - begins)


def possible_pairs(data: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (a < b) of entries with the same key and of different components whose sets may be similar.

    The rows of a component stand together in a bucket, so a large group costs nothing by itself.
    """
    key, size = data["key"].to_numpy(), data["size"].to_numpy()
    n, pos = size >> 32, size & 0xFFFFFFFF
    maps = [data[m].to_numpy().view(np.uint64) for m in MAPS]
    for a, b in _ranges(_bounds(key, component_of(data))[1], _bounds(key)[1]):
        both = n[a].astype(np.int64) + n[b]
        ok = OF * np.minimum(n[a], n[b]).astype(np.int64) >= SIMILAR * np.maximum(n[a], n[b]).astype(np.int64)
        least = -(-SIMILAR * both // (SIMILAR + OF))
        ok &= np.minimum(pos[a], pos[b]) + np.minimum(n[a] - pos[a], n[b] - pos[b]) >= least
        a, b, both, least = a[ok], b[ok], both[ok], least[ok]
        ok = both - sum(popcount(x[a] ^ x[b]) for x in maps) >= 2 * least
        yield a[ok], b[ok]


def component_of(data: pa.Table) -> np.ndarray:
    """Components; a set without one is its own."""
    return pc.coalesce(data["component"], data["node"]).to_numpy()


def by_component(data: pa.Table, seed: int) -> pa.Table:
    """Sorted by key, size of the component in the bucket (largest first) and component; members in an order that the seed gives."""
    component = component_of(data)
    data = data.set_column(data.schema.get_field_index("component"), "component", pa.array(component))
    key, node = data["key"].to_numpy(), data["node"].to_numpy().view(np.uint64)
    order = np.lexsort((component, key))
    begin, end = _bounds(key[order], component[order])
    members = np.empty(len(order), np.int64)
    members[order] = end - begin
    mixed = (node ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return data.take(pa.array(np.lexsort((mixed ^ (mixed >> np.uint64(29)), component, -members, key))))


def first_ones(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with the ``most`` first a of each b."""
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    ok = np.arange(len(b)) - _bounds(b)[0] < most if len(b) else np.zeros(0, bool)
    return a[ok], b[ok]


def close_pairs(owners: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets whose fingerprints differ by DISTANCE bits or fewer, one partner u of each v in a bucket.

    Pigeonring: a pair within the distance has a chain of segments, from one of the SEGMENTS starts on, that
    keeps to its share of the distance all along. A fingerprint goes to a bucket for each start by the
    segment there, which must be equal. Sets with equal fingerprints are one node of this.
    """
    width = BITS // SEGMENTS
    least = owners.groupBy("fp").agg(F.min("node").alias("u"))
    same = owners.join(least, "fp").where("node <> u").select("u", F.col("node").alias("v"))
    turned = [F.struct(F.lit(k).alias("chain"), (F.shiftleft("fp", width * k).bitwiseOR(F.shiftrightunsigned("fp", BITS - width * k)) if k else F.col("fp")).alias("ring")) for k in range(SEGMENTS)]
    spread = least.select(F.col("u").alias("node"), F.explode(F.array(*turned)).alias("r")).select("node", "r.ring", "r.chain")
    entries = spread.select((F.col("chain") * (1 << width) + F.shiftrightunsigned("ring", BITS - width)).cast("long").alias("key"), "ring", "node")

    def link(data: pa.Table) -> pa.RecordBatch | None:
        chain, found = data["key"].to_numpy() >> width, [np.zeros((0, 2), np.int64)]
        for c in np.unique(chain):
            part = data.filter(pa.array(chain == c))
            ring, node = part["ring"].to_numpy().view(np.uint64), part["node"].to_numpy()
            order = np.argsort(ring)
            ring, node = ring[order], node[order]
            for a, b in ring_pairs(ring, DISTANCE, SEGMENTS, NEAR, PAIR_ROWS):
                a, b = first_ones(a, b, 1)
                found.append(np.stack([node[a], node[b]], axis=1))
        return pair_batch(np.sort(np.concatenate(found), axis=1))

    return by_bucket(entries, link, "u long, v long").unionByName(same).distinct()


def pair_batch(pairs: np.ndarray) -> pa.RecordBatch | None:
    pairs = np.unique(pairs, axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in pairs.T], ["u", "v"]) if len(pairs) else None


def candidate_pairs(entries: DataFrame, maps: DataFrame, labels: DataFrame, seed: int | None = None) -> DataFrame:
    """Pairs (u, v) between different components that the filters let pass.

    ``labels``: node, component. With a seed a few partners of larger components for each set in a bucket,
    drawn by the seed; else all pairs.
    """

    def link(data: pa.Table) -> pa.RecordBatch | None:
        data = by_component(data, seed or 0)
        node = data["node"].to_numpy()
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in possible_pairs(data):
            if seed is not None:
                a, b = first_ones(a, b, TRIED)
            u.append(a)
            v.append(b)
        a, b = np.concatenate(u), np.concatenate(v)
        if seed is not None:
            a, b = first_ones(a, b, TRIED)
        pairs = np.stack([node[a], node[b]], axis=1)
        return pair_batch(np.sort(pairs, axis=1) if seed is None else pairs)

    return by_bucket(entries, link, "u long, v long", maps, labels).distinct()


def likely_pairs(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """The pairs that the wide maps let pass: nearly all that are similar and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = both - 2 * -(-SIMILAR * both // (SIMILAR + OF))
            ok = [least_different(x, y) <= m for x, y, m in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    x, y = (owners.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in ("u", "v"))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "n_u", "n_v", "wide_u", "wide_v").mapInArrow(run, "u long, v long")


def one_partner(pairs: DataFrame, seed: int) -> DataFrame:
    """One partner of each set, drawn by the seed: links of a group make the others of the group needless."""
    return pairs.groupBy("v").agg(F.min_by("u", F.xxhash64("u", F.lit(seed))).alias("u")).select("u", "v")


def similar_pairs(pairs: DataFrame, owners: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs whose sets are similar, by the sets themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        set_of = lru_cache(maxsize=4)(lambda packed: shingle_set(unpack.decompress(packed), shingle))
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = set_of(x.as_py()), set_of(y.as_py())
                shared = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(OF * shared >= SIMILAR * (len(a) + len(b) - shared))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    named = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = owners.select("doc_id", "node").join(named, "node", "left_semi")
    # Grouped by node already, so both joins read the same shuffle of the texts.
    needed = packed_texts(wanted, texts, shingle)
    x, y = (needed.select(F.col("node").alias(c), F.col("data").alias(f"data_{c}")) for c in ("u", "v"))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "data_u", "data_v").mapInArrow(run, "u long, v long")


def collect(spark: SparkSession) -> None:
    """Broadcasts and shuffles of jobs that are done are let go once the driver has collected them."""
    spark._jvm.System.gc()


def near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable) over texts with a shingle similarity of 0.8 or more.

    Texts are lower-cased (A-Z only) and cut at ASCII white space. No similar pair is missed: two
    similar sets share a shingle of their prefixes, and the filters after that only drop what can't
    be similar. First sets meet by SimHash fingerprints, along chains of segments; that joins most
    groups by one pair a set. Then each set is held against one partner of a larger group that shares
    a prefix shingle; at last all such pairs that are still between different groups are checked. Equal sets are one node (by 64 bits of
    their digest), and all texts without words are one. Rows without a doc_id take no part in links.
    An empty table gives no rows. The result is written once; what was written on the way is removed.
    """
    texts = texts_of(docs)
    scratch = Scratch(docs.sparkSession, "near-copies")
    members = scratch.write(shingle_sets(texts, shingle), "members")
    owners = scratch.write(members.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("fp", "n", *MAPS, "wide"))), "owners")
    entries = scratch.write(prefix_entries(owners, texts, shingle), "prefixes")
    maps = owners.select("node", *MAPS)

    def likely(pairs: DataFrame) -> DataFrame:
        return scratch.write(likely_pairs(pairs, owners), "likely")

    def sure(pairs: DataFrame) -> DataFrame:
        found = scratch.write(similar_pairs(scratch.write(pairs, "pairs"), owners, texts, shingle), "similar")
        collect(docs.sparkSession)
        return found

    def components(links: DataFrame) -> DataFrame:
        return scratch.write(connected_components(links, scratch.write), "labels")

    labels = components(sure(one_partner(likely(close_pairs(owners)), 0)))
    for seed in range(1, ROUNDS + 1):
        links = sure(one_partner(likely(candidate_pairs(entries, maps, labels, seed)), seed))
        if links.isEmpty():
            break
        labels = components(labels.toDF("u", "v").unionByName(links))
    links = sure(likely(candidate_pairs(entries, maps, labels)))
    if not links.isEmpty():
        labels = components(labels.toDF("u", "v").unionByName(links))
    named = members.join(labels, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = materialise(named.join(least, "component").select("doc_id", "component_id"), "near-copies-found")
    scratch.clear()
    collect(docs.sparkSession)
    return found
