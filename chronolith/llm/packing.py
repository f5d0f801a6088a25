"""Op 1: first-fit decreasing packing by a tournament tree of bin capacities, in random groups."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, small_batches, table
from .tokens import vocabulary, word_encoder

#: Documents that one group packs, on average; bounds the memory of a packing task.
GROUP_DOCS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Tournament tree whose leaves are bins and whose nodes hold the largest free capacity below."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Takes ``size`` from the lowest-numbered bin with room for it and returns that bin."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        left = free[node] - size
        bin_ = node - self.leaves
        free[node] = left
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; sizes must be within the capacity. Ties keep the given order."""
    order = np.argsort(-sizes, kind="stable")
    tree = CapacityTree(len(sizes), capacity)
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    filled: dict[int, int] = {}
    for item in order.tolist():
        size = int(sizes[item])
        b = tree.first_fit(size)
        bins[item] = b
        offsets[item] = filled.get(b, 0)
        filled[b] = filled.get(b, 0) + size
    return bins, offsets


def cut_points(n: int, capacity: int, grain: int) -> list[int]:
    """Full sequences first; what is left over is cut into a piece of whole ``grain`` and a rest."""
    cuts = list(range(0, n, capacity))
    rest = n - cuts[-1] if cuts else 0
    if grain < rest < capacity and rest % grain:
        cuts.append(cuts[-1] + rest // grain * grain)
    return cuts


def tokenised_pieces(docs: DataFrame, vocab: str, capacity: int, end_id: int, grain: int, with_ids: bool) -> DataFrame:
    """One row for each piece of each document; every token id lies in exactly one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(vocab), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in chunks(texts, lambda t: len(t or b"")):
                rows: list[tuple] = []
                for doc_id, body in zip(ids[a:b], encoder.encode(texts[a:b])):
                    body += end
                    n = len(body) // 4
                    cuts = cut_points(n, capacity, grain)
                    for s, e in zip(cuts, [*cuts[1:], n]):
                        part = body[4 * s : 4 * e]
                        rows.append((doc_id, s, e - s, zlib.crc32(part), n, *([part] if with_ids else [])))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
                kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return texts.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def pack_documents(
    docs: DataFrame,
    vocab: str | None = None,
    capacity: int = 4096,
    end_id: int = 2,
    group_docs: int = GROUP_DOCS,
    grain: int = 1024,
    seed: int = 7,
    with_ids: bool = False,
) -> DataFrame:
    """Packs the token ids of all documents into sequences of at most ``capacity`` ids.

    Each document is its ids plus ``end_id``. Whole sequences are cut off a long document first;
    what is left, cut once more at a multiple of ``grain``, is packed with other documents' pieces
    by first-fit decreasing. Pieces are dealt to random groups by a hash of document and start, so
    no document, source or text can make a group large; each group is packed on its own and takes
    about ``group_docs`` documents.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids as
    little-endian unsigned 32-bit binary if ``with_ids``). A null or empty text is its end id alone;
    repeated rows and null doc_ids are packed like any other; an empty table gives no rows; other
    columns are ignored. Ties in size keep the order of doc_id, start and checksum.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = tokenised_pieces(docs, vocab or vocabulary(), capacity, end_id, grain, with_ids)
    groups = max(1, math.ceil(docs.count() / group_docs))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", F.lit(seed)), F.lit(groups)))
    schema = f"{PIECES}, sequence_id long, offset long" + (", ids binary" if with_ids else "")

    names = [c.split()[0] for c in schema.split(", ")]

    def pack(key: tuple, items: pa.Table) -> pa.Table:
        items = items.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(items["length"].to_numpy(), capacity)
        items = items.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins))
        items = items.append_column("offset", pa.array(offsets))
        return items.select(names).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])

    return dealt.groupBy("group").applyInArrow(pack, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
