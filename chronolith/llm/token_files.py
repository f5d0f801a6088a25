"""Op 10: token ids in patched frame-of-reference blocks, written by Spark and read back.

Fixed format of a segment (all little-endian), one binary value in the row of a Parquet file:
  magic "PFR1", block length u32, documents u32, tokens u64, blocks u32
  doc_id i64 [documents], null flag u8 [documents], tokens u64 [documents]
  block start u32 [blocks + 1], counted from the end of this index
  blocks: minimum u32, width u8, exceptions u16, their places u16 [], their values u32 [],
          then ``width`` bit planes of block length / 8 bytes, lowest bit first.
Values are kept less the block's minimum. The width covers a percentile of them; the others'
high bits are in the exception list.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, fresh_path, small_batches, table
from .tokens import vocabulary, word_encoder

MAGIC = b"PFR1"
BLOCK = 512
#: Tokens after which a segment ends; bounds what a task holds.
SEGMENT_TOKENS = 131_072
#: Share of a block's values whose bits the block's width covers.
PERCENTILE = 0.9
_HEAD = struct.Struct("<4sIIQI")
_BLOCK = struct.Struct("<IBH")


def encode_blocks(values: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of BLOCK values each; the last is filled up with its own last value."""
    if not len(values):
        return []
    n = -(-len(values) // BLOCK)
    grid = np.full(n * BLOCK, values[-1], np.uint32)
    grid[: len(values)] = values
    grid = grid.reshape(n, BLOCK)
    low = grid.min(axis=1)
    grid = grid - low[:, None]
    chosen = np.partition(grid, int(percentile * (BLOCK - 1)), axis=1)[:, int(percentile * (BLOCK - 1))]
    widths = np.frexp(chosen.astype(np.float64))[1].astype(np.int64)
    blocks: list[bytes] = [b""] * n
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        part = grid[rows]
        packed = np.empty((len(rows), w, BLOCK // 8), np.uint8)
        for low_bit in range(0, w, 8):
            byte = (part >> np.uint32(low_bit)).astype(np.uint8)
            for bit in range(low_bit, min(w, low_bit + 8)):
                packed[:, bit] = np.packbits(byte & np.uint8(1 << bit - low_bit), axis=1)  # what isn't zero is a one
        high = part >> np.uint32(w) if w < 32 else np.zeros_like(part)
        counts = np.count_nonzero(high, axis=1)
        at = np.nonzero(high)
        values_out, places = high[at].astype("<u4"), at[1].astype("<u2")
        ends = np.cumsum(counts)
        for i, (row, e, c) in enumerate(zip(rows.tolist(), ends.tolist(), counts.tolist())):
            blocks[row] = b"".join(
                (_BLOCK.pack(int(low[row]), w, c), places[e - c : e].tobytes(), values_out[e - c : e].tobytes(), packed[i].tobytes())
            )
    return blocks


def decode_blocks(blocks: list[memoryview]) -> np.ndarray:
    """Values of blocks in a row; blocks of one width are unpacked together."""
    heads = [_BLOCK.unpack_from(b, 0) for b in blocks]
    out = np.zeros((len(blocks), BLOCK), np.uint32)
    widths = np.array([w for _, w, _ in heads], np.int64)
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        packed = b"".join([blocks[i][len(blocks[i]) - w * BLOCK // 8 :] for i in rows.tolist()]) if w else b""
        planes = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(len(rows), w, BLOCK // 8), axis=2)
        part = np.zeros((len(rows), BLOCK), np.uint32)
        for low_bit in range(0, w, 8):
            byte = np.zeros((len(rows), BLOCK), np.uint8)
            for bit in range(low_bit, min(w, low_bit + 8)):
                byte |= planes[:, bit] << np.uint8(bit - low_bit)
            part |= byte.astype(np.uint32) << np.uint32(low_bit)
        out[rows] = part
    for i, (_, w, n) in enumerate(heads):
        if n:
            at = _BLOCK.size
            out[i, np.frombuffer(blocks[i], "<u2", n, at)] |= np.frombuffer(blocks[i], "<u4", n, at + 2 * n) << np.uint32(w)
    out += np.array([low for low, _, _ in heads], np.uint32)[:, None]
    return out.reshape(-1)


def encode_segment(doc_ids: list, lengths: list[int], values: np.ndarray) -> bytes:
    blocks = encode_blocks(values)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u4")
    head = _HEAD.pack(MAGIC, BLOCK, len(doc_ids), len(values), len(blocks))
    ids = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return b"".join((head, ids, np.array(lengths, "<u8").tobytes(), starts.tobytes(), *blocks))


class SegmentReader:
    """Documents of one segment; ``read`` opens only the blocks that a range of ids lies in."""

    def __init__(self, data: bytes):
        magic, self.block, docs, self.tokens, blocks = _HEAD.unpack_from(data, 0)
        if magic != MAGIC or self.block != BLOCK:
            raise ValueError("not a segment of this format")
        at = _HEAD.size
        ids = np.frombuffer(data, "<i8", docs, at).tolist()
        nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs).tolist()
        self.doc_ids = [None if gone else d for d, gone in zip(ids, nulls)]
        self.lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        at += 17 * docs
        self.starts = np.frombuffer(data, "<u4", blocks + 1, at)
        self.body = memoryview(data)[at + 4 * (blocks + 1) :]

    def read(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        end = self.tokens if end is None else min(end, self.tokens)
        if begin >= end:
            return np.zeros(0, np.uint32)
        first, last = begin // BLOCK, -(-end // BLOCK)
        values = decode_blocks([self.body[self.starts[k] : self.starts[k + 1]] for k in range(first, last)])
        return values[begin - first * BLOCK : end - first * BLOCK]


def write_token_files(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = 1) -> None:
    """Encodes all documents in ascending doc_id order and writes segments under ``path``.

    Spark's own writer commits the files, so any store Spark reaches will do and a lost executor's
    part is written again. Columns: shard and segment (their order is doc_id order), n_tokens, data.
    Null text: the end id alone. Null doc_ids come first; rows that share a doc_id are ordered by
    text. Other columns are ignored.
    """
    vocab = vocab or vocabulary()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, segment = TaskContext.get().partitionId(), 0
        encoder, end = word_encoder(vocab), np.array([end_id], "<u4").tobytes()
        ids: list = []
        bodies: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(bodies), "<u4")
            data = encode_segment(ids, [len(b) // 4 for b in bodies], values)
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int64()), "segment": pa.array([segment], pa.int64()), "n_tokens": pa.array([len(values)], pa.int64()), "data": pa.array([data], pa.binary())}
            )

        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in chunks(texts, lambda t: len(t or b"")):
                for doc_id, body in zip(keys[a:b], encoder.encode(texts[a:b])):
                    ids.append(doc_id)
                    bodies.append(body + end)
                    held += len(body) // 4 + 1
                    if held >= SEGMENT_TOKENS:
                        yield flush()
                        segment, held, ids, bodies = segment + 1, 0, [], []
        if ids:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(run, "shard long, segment long, n_tokens long, data binary")
    written.write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 by document, and its ids (binary)."""
    files = spark.read.parquet(path)
    names = ["doc_id", "shard", "segment", "local", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, segment, data in zip(*(batch.column(c).to_pylist() for c in range(3))):
                reader = SegmentReader(data)
                body = reader.read().astype("<u4").tobytes()
                ends = np.cumsum(reader.lengths)
                parts = [body[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), reader.lengths.tolist())]
                docs = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.doc_ids, pa.int64()), pa.array([shard] * docs, pa.int64()), pa.array([segment] * docs, pa.int64()),
                        pa.array(ends - reader.lengths, pa.int64()), pa.array(reader.lengths, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()), *([pa.array(parts, pa.binary())] if with_ids else []),
                    ],
                    names,
                )

    read = files.select("shard", "segment", "data").mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))
    sizes = files.groupBy("shard", "segment").agg(F.sum("n_tokens").alias("n"))
    # One row a shard: the number of shards is the number of write tasks.
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before.alias("shard_start"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("segment_start", within).join(shards, "shard").select("shard", "segment", (F.col("shard_start") + F.col("segment_start")).alias("base"))
    return read.join(starts, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *names[6:])


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path, with_ids=False)
