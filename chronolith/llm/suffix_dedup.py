"""Op 7: bytes of repeated long strings, found by sorting the suffixes of candidate passages.

A string of LENGTH bytes has an anchor, the place of its least hashed K-gram, that depends on the
string alone. Copies of whole texts are settled first; anchors that different ones of the other
texts share are the candidates. What surrounds such an anchor, as far as the strings anchored there
reach, is its context. A context that an earlier document has too is removed whole (told by 128-bit
prints next to the 64-bit anchor); the different contexts of one anchor meet in the least document
that has each, their suffixes are sorted (grouping_sort), and runs of suffixes with LENGTH bytes in
common tell which strings also start in a document with a smaller doc_id.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import Scratch, fresh_path, small_batches, table
from .grouping_sort import suffix_array

LENGTH, K = 50, 24
WINDOW = LENGTH - K + 1
#: Bytes of text in one batch row, but for longer texts, and bytes that are searched for anchors at a time; that takes about 50 times as much.
BATCH_BYTES = 2_000_000
#: Anchors that one bucket of the candidate search gets, on average.
BUCKET_ANCHORS = 1_000_000
#: An anchor with more different contexts than the first is split by the bytes around it; a part with more than the second goes by grouped strings.
HOT_CONTEXTS, HOTTEST_CONTEXTS = 2_000, 20_000
#: Hot anchors (8 bytes each) that are broadcast at most; more are joined by a shuffle.
SENT_ANCHORS = 1_000_000
#: Places that a hot anchor may have in a string: strings of one range share the bytes around the anchor that all of them have.
RANGES = ((0, 8), (9, 17), (18, 26))
#: Bytes whose suffixes are sorted together, unless one anchor's contexts alone have more.
SORT_BYTES = 200_000
#: Stands for a mask where the whole text is a copy.
COPY = -1
_M = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of the K bytes that start at each place (the last K - 1 places: none)."""
    if len(data) < K:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * _M
        h ^= h >> np.uint64(29)
        size, power = 1, np.uint64(0xD1B54A32D192ED03)
        while size < 8:
            h = h[: len(h) - size] * power + h[size:]
            size, power = 2 * size, power * power
        h = (h[: len(h) - 16] * power + h[8 : len(h) - 8]) * power + h[16:]
        h ^= h >> np.uint64(32)
        h *= _M
        h ^= h >> np.uint64(29)
    return h


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each run of ``width`` values."""
    size = 1
    while 2 * size <= width:
        values = pick(values[: len(values) - size], values[size:])
        size *= 2
    return pick(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors in texts laid end to end, all hashes, and which places start a whole string.

    Every string of LENGTH bytes inside a text has all places of its least K-gram among the anchors.
    """
    h = gram_hashes(data)
    n = len(h) - WINDOW + 1
    whole = np.zeros(max(n, 0), bool)
    if n <= 0:
        return np.zeros(0, np.int64), h, whole
    for s, e in zip(starts.tolist(), ends.tolist()):
        if e - s >= LENGTH:
            whole[s : e - LENGTH + 1] = True
    least = np.where(whole, _sliding(h, WINDOW, np.minimum), np.uint64(0))
    pad = np.zeros(WINDOW - 1, np.uint64)
    return np.flatnonzero((_sliding(np.concatenate([pad, least, pad]), WINDOW, np.maximum) == h) & (h > 0)), h, whole


def reach(h: np.ndarray, whole: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings whose anchors include each of the places ``at``."""
    around = np.arange(-(WINDOW - 1), WINDOW)
    index = at[:, None] + around
    inside = (index >= 0) & (index < len(h))
    smaller = inside & (h[np.clip(index, 0, len(h) - 1)] < h[at][:, None])
    left, right = smaller[:, : WINDOW - 1][:, ::-1], smaller[:, WINDOW:]
    before = np.where(left.any(axis=1), left.argmax(axis=1), WINDOW - 1)  # places to the left without a smaller one
    after = np.where(right.any(axis=1), right.argmax(axis=1), WINDOW - 1)
    first, last = at - before, at - (WINDOW - 1) + after
    span = first[:, None] + np.arange(WINDOW)
    ok = (span <= np.minimum(last, at)[:, None]) & (span >= 0) & (span < len(whole))
    ok &= whole[np.clip(span, 0, len(whole) - 1)]
    found = ok.any(axis=1)
    lo = np.where(found, first + ok.argmax(axis=1), 0)
    hi = np.where(found, first + WINDOW - 1 - ok[:, ::-1].argmax(axis=1), -1)
    return lo, hi


def text_batches(docs: DataFrame) -> DataFrame:
    """Rows of about BATCH_BYTES of text: batch, doc_ids, ends (i64 each), digests (16 bytes each), data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts]).astype("<i8").tobytes()
            digests = b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts)
            columns = {"batch": pa.array([number], pa.int64()), "doc_ids": pa.array([np.array(ids, "<i8").tobytes()]), "ends": pa.array([ends]), "digests": pa.array([digests]), "data": pa.array([b"".join(texts)], pa.binary())}
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(text or b"")
                held += len(text or b"")
                if held >= BATCH_BYTES or len(ids) >= 20_000:
                    yield flush()
                    number, held, ids, texts = number + 1, 0, [], []
        if ids:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id is not null")
    return texts.mapInArrow(run, "batch long, doc_ids binary, ends binary, digests binary, data binary")


def pieces(starts: np.ndarray, stops: np.ndarray, live: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, docs, starts, ends) of parts of a batch, of about BATCH_BYTES each; starts and ends count from ``from``.

    A longer text is cut with an overlap, so that each of its strings starts in exactly one part.
    """
    held: list[tuple[int, int, int]] = []
    size = 0
    for doc in np.flatnonzero(live & (stops - starts >= LENGTH)).tolist():
        stop = int(stops[doc])
        for begin in range(int(starts[doc]), stop - LENGTH + 1, BATCH_BYTES):
            end = min(stop, begin + BATCH_BYTES + LENGTH - 1)
            held.append((doc, begin, end))
            size += end - begin
            if size >= BATCH_BYTES:
                yield _part(held)
                held, size = [], 0
    if held:
        yield _part(held)


def _part(held: list[tuple[int, int, int]]) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    found = np.array(held, np.int64)
    base = int(found[0, 1])
    return base, int(found[-1, 2]), found[:, 0], found[:, 1] - base, found[:, 2] - base


def _live(count: int, copies: bytes | None) -> np.ndarray:
    live = np.ones(count, bool)
    if copies:
        live[np.frombuffer(copies, "<u4")] = False
    return live


def _opened(data: bytes, ends: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e = np.frombuffer(ends, "<i8")
    return np.frombuffer(data, np.uint8), np.concatenate([[0], e[:-1]]), e


def shared_anchors(batches: DataFrame, copies: DataFrame, buckets: int) -> DataFrame:
    """batch, keys: of each batch, the (shortened) hashes of anchors that another text has too.

    ``copies`` (batch, copies) are texts that take no part. Hashes travel as packed arrays, by
    bucket, each next to the place of its text in the batch. A shortened hash may name a few anchors
    too many; those fall out when their contexts are compared.
    """

    def scatter(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for batch, ends, data, gone in zip(*(row.column(c).to_pylist() for c in range(4))):
                bytes_, starts, stops = _opened(data, ends)
                for base, end, docs, begins, ends_ in pieces(starts, stops, _live(len(stops), gone)):
                    at, h, _ = anchors(bytes_[base:end], begins, ends_)
                    if not len(at):
                        continue
                    key = h[at]
                    bucket = (key >> np.uint64(32)).astype(np.int64) % buckets
                    text = docs[np.searchsorted(ends_, at, "right")]
                    pairs = np.stack([key.astype(np.uint32), text.astype(np.uint32)], axis=1).astype("<u4")
                    order = np.argsort(bucket, kind="stable")
                    bucket, pairs = bucket[order], pairs[order]
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array(bucket[cuts[:-1]]), "batch": pa.array(np.full(len(cuts) - 1, batch)),
                        "pairs": pa.array([pairs[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary()),
                    })

    def compare(bucket: int, batches_: list[int], parts: list[bytes]) -> pa.RecordBatch | None:
        pairs = np.frombuffer(b"".join(parts), "<u4").reshape(-1, 2)
        number = {batch: k for k, batch in enumerate(dict.fromkeys(batches_))}
        sources = list(number)
        source = np.repeat([number[b] for b in batches_], [len(p) // 8 for p in parts])
        order = np.argsort(pairs[:, 0], kind="stable")
        key, source = pairs[order, 0], source[order]
        text = (source.astype(np.uint64) << np.uint64(32)) | pairs[order, 1]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        sizes = np.diff(np.concatenate([cuts, [len(key)]]))
        shared = np.repeat(np.minimum.reduceat(text, cuts) != np.maximum.reduceat(text, cuts), sizes)
        key, source = key[shared], source[shared]
        if not len(key):
            return None
        found = np.unique(np.stack([source.astype(np.uint64), (np.uint64(bucket) << np.uint64(32)) | key.astype(np.uint64)], axis=1), axis=0)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(found[:, 0])) + 1, [len(found)]])
        return pa.RecordBatch.from_pydict({"batch": pa.array([sources[int(found[a, 0])] for a in cuts[:-1]], pa.int64()), "keys": pa.array([found[a:b, 1].astype("<u8").tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sources, parts = None, [], []
        for row in rows:
            for bucket, batch, pairs in zip(*(row.column(c).to_pylist() for c in range(3))):
                if bucket != now:
                    if parts and (found := compare(now, sources, parts)) is not None:
                        yield found
                    now, sources, parts = bucket, [], []
                sources.append(batch)
                parts.append(pairs)
        if parts and (found := compare(now, sources, parts)) is not None:
            yield found

    joined = batches.select("batch", "ends", "data").join(copies.hint("shuffle_hash"), "batch", "left")
    spread = joined.select("batch", "ends", "data", "copies").mapInArrow(scatter, "bucket long, batch long, pairs binary")
    return spread.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, "batch long, keys binary")


MARKS = "batch long, at binary, lo binary, hi binary, place binary, entries binary"


def shared_marks(batches: DataFrame, copies: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """Packed arrays of each batch's shared anchors: places, first and last string starts, and the row of ``entries`` each belongs to.

    entries: bucket, anchor and 128-bit print of each different context, and the least doc_id of the
    batch that has it, by bucket.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for batch, doc_ids, ends, data, gone, keys in zip(*(row.column(c).to_pylist() for c in range(6))):
                bytes_, starts, stops = _opened(data, ends)
                wanted = np.sort(np.frombuffer(b"".join(keys), "<u8"))
                found = []
                for base, end, docs, begins, ends_ in pieces(starts, stops, _live(len(stops), gone)):
                    at, h, whole = anchors(bytes_[base:end], begins, ends_)
                    bucket = (h[at] >> np.uint64(32)) % np.uint64(buckets)
                    short = (bucket << np.uint64(32)) | (h[at] & np.uint64(0xFFFFFFFF))
                    known = wanted[np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)] == short
                    at, bucket = at[known], bucket[known]
                    lo, hi = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                    for k in range(0, len(at), 50_000):
                        lo[k : k + 50_000], hi[k : k + 50_000] = reach(h, whole, at[k : k + 50_000])
                    ok = hi >= lo
                    at, lo, hi, bucket = at[ok], lo[ok], hi[ok], bucket[ok]
                    found.append((at + base, lo + base, hi + base, bucket.astype(np.int64), h[at].view(np.int64), docs[np.searchsorted(ends_, at, "right")]))
                at, lo, hi, bucket, anchor, doc = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 6
                if not len(at):
                    continue
                prints = np.frombuffer(b"".join(map(xxh3_128_digest, (data[x:y] for x, y in zip(lo.tolist(), (hi + LENGTH).tolist())))), "<i8").reshape(-1, 2)
                order = np.lexsort((prints[:, 1], prints[:, 0], anchor, bucket))
                first = np.ones(len(at), bool)
                first[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in (anchor, prints[:, 0], prints[:, 1])], axis=0)
                place = np.empty(len(at), np.int64)
                place[order] = np.cumsum(first) - 1
                chosen = order[first]
                least = np.full(len(chosen), np.iinfo(np.int64).max)
                np.minimum.at(least, place, np.frombuffer(doc_ids, "<i8")[doc])
                entries = np.column_stack([bucket[chosen], anchor[chosen], prints[chosen], least])
                parts = [at.astype("<u4"), (at - lo).astype(np.uint8), (at - hi).astype(np.int8), place.astype("<u4"), entries.astype("<i8")]
                yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], [c.split()[0] for c in MARKS.split(", ")])

    joined = batches.select("batch", "doc_ids", "ends", "data").join(copies.hint("shuffle_hash"), "batch", "left").join(shared.hint("shuffle_hash"), "batch")
    return joined.select("batch", "doc_ids", "ends", "data", "copies", "keys").mapInArrow(run, MARKS)


def _marks(at: bytes, lo: bytes, hi: bytes, place: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    places = np.frombuffer(at, "<u4").astype(np.int64)
    return places, places - np.frombuffer(lo, np.uint8), places - np.frombuffer(hi, np.int8), np.frombuffer(place, "<u4")


def context_rules(marks: DataFrame) -> DataFrame:
    """batch, rules: for each context of the batch, the least doc_id that has it and whether its anchor has others.

    Contexts travel as 128-bit prints next to their 64-bit anchors, packed by bucket, each once per
    batch with its least doc_id; so a passage that a third of all documents share costs its bucket
    one entry a batch.
    """

    def scatter(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for batch, data in zip(row.column(0).to_pylist(), row.column(1).to_pylist()):
                entries = np.frombuffer(data, "<i8").reshape(-1, 5)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(entries[:, 0])) + 1, [len(entries)]]).tolist()
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(entries[cuts[:-1], 0]), "batch": pa.array(np.full(len(cuts) - 1, batch)),
                    "packed": pa.array([entries[x:y, 1:].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary()),
                })

    def rule(bucket: int, sources: list[int], parts: list[bytes]) -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(parts), "<i8").reshape(-1, 4)
        order = np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))
        after, before = rows[order[1:]], rows[order[:-1]]
        new_anchor = np.ones(len(rows), bool)
        new_anchor[1:] = after[:, 0] != before[:, 0]
        new_context = new_anchor.copy()
        new_context[1:] |= (after[:, 1] != before[:, 1]) | (after[:, 2] != before[:, 2])
        anchor, context = np.cumsum(new_anchor) - 1, np.cumsum(new_context) - 1
        many = np.bincount(anchor, weights=new_context) > 1
        out = np.zeros((len(rows), 2), "<i8")
        out[order, 0] = rows[order, 3][new_context][context]
        out[order, 1] = many[anchor]
        ends = np.cumsum([len(p) // 32 for p in parts]).tolist()
        return pa.RecordBatch.from_pydict({"batch": pa.array(sources, pa.int64()), "bucket": pa.array([bucket] * len(parts), pa.int64()), "rules": pa.array([out[e - len(p) // 32 : e].tobytes() for e, p in zip(ends, parts)], pa.binary())})

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sources, parts = None, [], []
        for row in rows:
            for bucket, batch, packed in zip(*(row.column(c).to_pylist() for c in range(3))):
                if bucket != now:
                    if parts:
                        yield rule(now, sources, parts)
                    now, sources, parts = bucket, [], []
                sources.append(batch)
                parts.append(packed)
        if parts:
            yield rule(now, sources, parts)

    spread = marks.select("batch", "entries").mapInArrow(scatter, "bucket long, batch long, packed binary")
    ruled = spread.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, "batch long, bucket long, rules binary")
    listed = ruled.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "rules"))).alias("r"))
    return listed.select("batch", F.col("r.rules").alias("rules"))


def own_contexts(batches: DataFrame, ruled: DataFrame) -> DataFrame:
    """anchor, context, left (the anchor's place in it), least, batch, doc, start: contexts of anchors with several, in the least document that has them."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for batch, doc_ids, ends, data, *packed, entries, rules in zip(*(row.column(c).to_pylist() for c in range(10))):
                _, starts, stops = _opened(data, ends)
                at, lo, hi, place = _marks(*packed)
                rule = np.frombuffer(b"".join(rules), "<i8").reshape(-1, 2)[place]
                doc = np.searchsorted(stops, at, "right")
                ids = np.frombuffer(doc_ids, "<i8")[doc]
                anchor = np.frombuffer(entries, "<i8").reshape(-1, 5)[place, 1]
                own = np.flatnonzero((ids == rule[:, 0]) & (rule[:, 1] > 0))
                for k in range(0, len(own), 20_000):
                    part = own[k : k + 20_000]
                    yield pa.RecordBatch.from_pydict({
                        "anchor": pa.array(anchor[part]), "context": pa.array([data[x:y] for x, y in zip(lo[part].tolist(), (hi[part] + LENGTH).tolist())], pa.binary()),
                        "left": pa.array((at - lo)[part]), "least": pa.array(ids[part]), "batch": pa.array(np.full(len(part), batch)), "doc": pa.array(doc[part].astype(np.int64)), "start": pa.array((lo - starts[doc])[part]),
                    })

    joined = batches.select("batch", "doc_ids", "ends", "data").join(ruled.hint("shuffle_hash"), "batch")
    return joined.select("batch", "doc_ids", "ends", "data", "at", "lo", "hi", "place", "entries", "rules").mapInArrow(run, "anchor long, context binary, left long, least long, batch long, doc long, start long")


def many_contexts(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """anchor: those with more than ``limit`` contexts; sent to all tasks if they are few enough, so that theirs stay apart."""
    found = scratch.write(rows.groupBy("anchor").agg(F.count("*").alias("n")).where(f"n > {limit}").select("anchor"), "hot-anchors")
    return F.broadcast(found) if found.count() <= SENT_ANCHORS else found


def split_hot(rows: DataFrame) -> DataFrame:
    """The contexts of hot anchors in parts, by the range that the anchor's place in a string is in.

    Strings of a range share some bytes before and after the anchor, which become part of the key,
    so that contexts meet where they can have a string in common and few of them meet in vain.
    """
    parts = []
    for number, (low, high) in enumerate(RANGES):
        begin, last = f"greatest(0, left - {high})", f"least(length(context) - {LENGTH}, left - {low})"
        around = f"substring(context, cast(left - {low} + 1 AS int), {low + LENGTH - high})"
        parts.append(f"named_struct('key', xxhash64(anchor, {number}, {around}), 'begin', {begin}, 'last', {last})")
    each = rows.withColumn("part", F.explode(F.expr(f"array({', '.join(parts)})"))).where("part.last >= part.begin")
    cut = f"substring(context, cast(part.begin + 1 AS int), cast(part.last - part.begin + {LENGTH} AS int))"
    return each.selectExpr("part.key AS anchor", f"{cut} AS context", "least", "batch", "doc", "start + part.begin AS start")


def least_of_strings(texts: list[bytes], least: list[int]) -> list[list[int]]:
    """For each place of each text that starts a whole string: the smallest ``least`` of the texts that have the string.

    The texts are laid end to end, each closed by a separator of its own; suffixes that begin a
    whole string are taken in suffix order, and neighbours that agree in LENGTH bytes form runs.
    """
    out = [[0] * (len(t) - LENGTH + 1) for t in texts]
    laid: list[int] = []
    owner: list[int] = []
    base = len(texts)
    for k, t in enumerate(texts):
        laid += [base + byte for byte in t]
        laid.append(k)
        owner += [k] * (len(t) + 1)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).tolist()
    run: list[tuple[int, int]] = []
    last = b""

    def close() -> None:
        low = min((least[k] for k, _ in run), default=0)
        for k, offset in run:
            out[k][offset] = low

    for place in suffix_array(laid):
        k = owner[place]
        offset = place - begins[k]
        string = texts[k][offset : offset + LENGTH]
        if len(string) < LENGTH:
            continue
        if string != last:
            close()
            run.clear()
            last = string
        run.append((k, offset))
    close()
    return out


def live_runs(context: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last) of runs of string starts whose strings, by their hashes, other contexts of the list have too."""
    joined = np.frombuffer(b"".join(context), np.uint8)
    lengths = np.array([len(c) for c in context])
    owner = np.repeat(np.arange(len(context)), lengths)
    begins = np.cumsum(lengths) - lengths
    with np.errstate(over="ignore"):
        h = (joined.astype(np.uint64) + np.uint64(1)) * _M
        h ^= h >> np.uint64(29)
        size, power, whole, have = 1, np.uint64(0xD1B54A32D192ED03), None, 0
        while size <= LENGTH:
            if LENGTH & size:
                # Strings of ``have`` bytes, then ``size`` more.
                whole = h if whole is None else whole[: len(h) - have] * power + h[have:]
                have += size
            h = h[: max(0, len(h) - size)] * power + h[size:]
            size, power = 2 * size, power * power
    n = len(whole)
    at = np.flatnonzero(np.arange(n) + LENGTH <= (begins + lengths)[owner[:n]])
    order = np.argsort(whole[at], kind="stable")
    hashes, own = whole[at][order], owner[at][order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(hashes)) + 1])
    many = np.minimum.reduceat(own, cuts) != np.maximum.reduceat(own, cuts)
    live = np.sort(at[order[np.repeat(many, np.diff(np.concatenate([cuts, [len(own)]])))]])
    if not len(live):
        return live, live, live
    new = np.ones(len(live), bool)
    new[1:] = (np.diff(live) > 1) | (np.diff(owner[live]) > 0)
    first, last = live[new], live[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(live) - 1]])]
    return owner[first], first - begins[owner[first]], last - begins[owner[first]]


def sorted_masks(rows: DataFrame) -> DataFrame:
    """batch, doc, start, mask of contexts (anchor, context, least, batch, doc, start), by suffix sorting."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        if not rows:
            return None
        distinct: dict[bytes, int] = {}
        of: list[list[int]] = []
        for i, r in enumerate(rows):
            k = distinct.setdefault(r[1], len(distinct))
            if k == len(of):
                of.append([])
            of[k].append(i)
        context = list(distinct)
        # What contexts share is mostly the same text, cut out of different surroundings: each once.
        texts: dict[bytes, int] = {}
        least: list[int] = []
        runs = []
        for k, a, b in zip(*(x.tolist() for x in live_runs(context))):
            t = texts.setdefault(context[k][a : b + LENGTH], len(texts))
            low = min(rows[i][2] for i in of[k])
            if t == len(least):
                least.append(low)
            else:
                least[t] = min(least[t], low)
            runs.append((k, a, t))
        lows = least_of_strings(list(texts), least)
        ends = [(min(x), max(x)) for x in lows]
        masks: dict[int, int] = {}
        for c, same in zip(context, of):  # parts of different contexts may be equal as a whole
            low = min(rows[i][2] for i in same)
            for i in same:
                if low < rows[i][2]:
                    masks[i] = (1 << len(c) - LENGTH + 1) - 1
        for k, a, t in runs:
            for i in of[k]:
                own = rows[i][2]
                if ends[t][1] < own:
                    masks[i] = masks.get(i, 0) | ((1 << len(lows[t])) - 1) << a
                elif ends[t][0] < own:
                    masks[i] = masks.get(i, 0) | sum(1 << a + o for o, low in enumerate(lows[t]) if low < own)
        hit = list(masks)
        return pa.RecordBatch.from_pydict({"batch": pa.array([rows[i][3] for i in hit], pa.int64()), "doc": pa.array([rows[i][4] for i in hit], pa.int64()), "start": pa.array([rows[i][5] for i in hit], pa.int64()), "mask": pa.array(list(masks.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if size >= SORT_BYTES and held[-1][0] != r[0]:
                    if (found := solve(held)) is not None:
                        yield found
                    held, size = [], 0
                held.append(r)
                size += len(r[1])
        if (found := solve(held)) is not None:
            yield found

    ordered = rows.select("anchor", "context", "least", "batch", "doc", "start").repartition("anchor").sortWithinPartitions("anchor", "context")
    return ordered.mapInArrow(run, "batch long, doc long, start long, mask long")


def hot_masks(rows: DataFrame, scratch: Scratch, often: int = HOT_CONTEXTS // 4) -> DataFrame:
    """The same for what very many contexts share around an anchor: equal strings meet by a grouped minimum.

    Strings found more than ``often`` are sent to all tasks, if they are few enough, and the others joined.
    """
    strings = rows.select("batch", "doc", "start", "context", "least", F.explode(F.sequence(F.lit(0), F.length("context") - LENGTH)).alias("at"))
    strings = strings.select("batch", "doc", "start", "at", "least", F.expr(f"substring(context, at + 1, {LENGTH})").alias("string"))
    lowest = strings.groupBy("string").agg(F.min("least").alias("lowest"), F.max("least").alias("highest"), F.count("*").alias("n"))
    lowest = scratch.write(lowest.where("lowest < highest").drop("highest"), "lowest")
    common, rare = lowest.where(f"n > {often}").drop("n"), lowest.where(f"n <= {often}").drop("n")
    common = F.broadcast(common) if common.count() <= SENT_ANCHORS else common
    found = strings.join(common, "string").unionByName(strings.join(common, "string", "left_anti").join(rare, "string"))
    return found.where("lowest < least").groupBy("batch", "doc", "start").agg(F.expr("bit_or(shiftleft(1L, at))").alias("mask"))


def without_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """n_removed, n_spans and what is left, given [start, end) spans in any order."""
    kept, removed, runs, end = [], 0, 0, 0
    for s, e in sorted(spans):
        if e <= end:
            continue
        if s > end or not runs:
            kept.append(data[end:s])
            runs += 1
        begin = max(s, end)
        removed += e - begin
        end = e
    kept.append(data[end:])
    return removed, runs, b"".join(kept)


def mask_spans(start: int, mask: int) -> Iterator[tuple[int, int]]:
    k = 0
    while mask >> k:
        if mask >> k & 1:
            begin = k
            while mask >> k & 1:
                k += 1
            yield start + begin, start + k - 1 + LENGTH
        k += 1


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed_strings(docs: DataFrame, with_text: bool = False, hot_contexts: int = HOT_CONTEXTS, hottest_contexts: int = HOTTEST_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary, if ``with_text``).

    Removes each byte of a document's UTF-8 text that lies in a string of 50 bytes which also starts
    in a document with a smaller doc_id; overlaps count, matches stay inside documents, and strings
    are judged on the input. Texts that are equal as a whole (by 128-bit digests) lose everything,
    but for the smallest doc_id's (under 50 bytes: nothing). Null text is empty; rows that share a
    doc_id don't count against each other; rows without a doc_id lose nothing and count against
    none. A text of any length is searched in parts that overlap. Other columns are ignored; an
    empty table gives no rows. The result is written once; all tables on the way are removed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "suffix-dedup")
    name, marks_name = (f"{kind}_{uuid.uuid4().hex}" for kind in ("text_batches", "text_marks"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bucketed, so that the joins below move only what joins the texts, not the texts.
    text_batches(docs).write.option("compression", "zstd").bucketBy(parts, "batch").saveAsTable(name)
    batches = spark.table(name)
    total = batches.select(F.sum(F.length("data"))).first()[0] or 0
    buckets = max(16, total // 12 // BUCKET_ANCHORS)

    def listed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for batch, ids, ends, digests in zip(*(row.column(c).to_pylist() for c in range(4))):
                n = len(ids) // 8
                sizes = np.diff(np.frombuffer(ends, "<i8"), prepend=0)
                yield pa.RecordBatch.from_pydict({"batch": pa.array(np.full(n, batch)), "doc": pa.array(np.arange(n)), "doc_id": pa.array(np.frombuffer(ids, "<i8")), "n_bytes": pa.array(sizes), "digest": pa.array([digests[16 * i : 16 * i + 16] for i in range(n)], pa.binary())})

    texts = batches.select("batch", "doc_ids", "ends", "digests").mapInArrow(listed, "batch long, doc long, doc_id long, n_bytes long, digest binary").where(f"n_bytes >= {LENGTH}")
    texts = scratch.write(texts, "text-digests")
    first = texts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copied = scratch.write(texts.join(first, "digest").where("first < doc_id").groupBy("batch").agg(F.collect_list("doc").alias("docs")), "copies")

    def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            yield pa.RecordBatch.from_arrays([row.column(0), pa.array([np.array(d, "<u4").tobytes() for d in row.column(1).to_pylist()], pa.binary())], ["batch", "copies"])

    copies = scratch.write(copied.mapInArrow(packed, "batch long, copies binary"), "packed-copies")
    shared = scratch.write(shared_anchors(batches, copies, buckets).groupBy("batch").agg(F.collect_list("keys").alias("keys")), "shared-anchors")
    shared_marks(batches, copies, shared, buckets).write.option("compression", "zstd").bucketBy(parts, "batch").saveAsTable(marks_name)
    marks = spark.table(marks_name)
    ruled = marks.join(scratch.write(context_rules(marks), "context-rules").hint("shuffle_hash"), "batch")
    own = scratch.write(own_contexts(batches, ruled), "contexts")
    hot = many_contexts(own, hot_contexts, scratch)
    split = scratch.write(split_hot(own.join(hot, "anchor", "left_semi")), "split-contexts")
    # What is the same in 42 of 50 bytes more often than that goes by grouped strings.
    hotter = many_contexts(split, hottest_contexts, scratch)
    masks = sorted_masks(own.join(hot, "anchor", "left_anti").drop("left").unionByName(split.join(hotter, "anchor", "left_anti"))).unionByName(hot_masks(split.join(hotter, "anchor", "left_semi"), scratch))
    whole = copied.select("batch", F.explode("docs").alias("doc"), F.lit(0).cast("long").alias("start"), F.lit(COPY).cast("long").alias("mask"))
    spans = scratch.write(masks.unionByName(whole).groupBy("batch").agg(F.collect_list(F.struct("doc", "start", "mask")).alias("spans")), "spans")
    schema = RESULT + (", kept binary" if with_text else "")
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for i in range(row.num_rows):
                ids, ends, data, *packed, rules = (row.column(c)[i].as_py() for c in range(8))
                lists = row.column(8)[i]
                of: dict[int, list[tuple[int, int]]] = {}
                doc_ids, stops = np.frombuffer(ids, "<i8"), np.frombuffer(ends, "<i8")
                sizes = np.diff(stops, prepend=0).tolist()
                if rules:
                    at, lo, hi, place = _marks(*packed)
                    doc, starts = np.searchsorted(stops, at, "right"), stops - np.array(sizes)
                    whole = doc_ids[doc] > np.frombuffer(b"".join(rules), "<i8").reshape(-1, 2)[place, 0]
                    begin, end = (lo - starts[doc])[whole].tolist(), (hi + LENGTH - starts[doc])[whole].tolist()
                    for d, x, y in zip(doc[whole].tolist(), begin, end):
                        of.setdefault(d, []).append((x, y))
                if lists.is_valid:
                    for d, start, mask in zip(*(f.to_pylist() for f in lists.values.flatten())):
                        of.setdefault(d, []).extend([(0, sizes[d])] if mask == COPY else mask_spans(start, mask))
                out = []
                for d, (doc_id, end, size) in enumerate(zip(doc_ids.tolist(), stops.tolist(), sizes)):
                    removed, runs, kept = without_spans(data[end - size : end], of.get(d, []))
                    out.append((doc_id, size, removed, runs, hashlib.sha256(kept).hexdigest(), kept)[: len(kinds)])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in schema.split(", ")])

    texts = batches.select("batch", "doc_ids", "ends", "data")
    found = texts.join(ruled.drop("entries").hint("shuffle_hash"), "batch", "left").join(spans.hint("shuffle_hash"), "batch", "left")
    result = found.select("doc_ids", "ends", "data", "at", "lo", "hi", "place", "rules", "spans").mapInArrow(cut, schema)
    nameless = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    nameless = nameless.select("doc_id", F.length("data").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"), *([F.col("data").alias("kept")] if with_text else []))
    path = fresh_path(spark, "removed-strings")
    result.unionByName(nameless).write.option("compression", "zstd").parquet(path)
    for table_name in (name, marks_name):
        spark.sql(f"DROP TABLE {table_name}")
    scratch.clear()
    return spark.read.schema(schema).parquet(path)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_strings(table(spark, sf_dir, "documents"))
