"""Op 11: alignment of two tokenizers' tokens by common byte offsets, in Arrow.

Per chunk of documents, all in Arrow: token lists are flattened, byte ends are running sums, a hash
join on (document, end) finds where tokens of both end, running sums of those marks number the
groups, and a second hash join on the group links tokens. ``Table.group_by`` counts the chunk's
documents by linked pair; Spark merges these partial counts and brings each chunk the totals of its
own pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import Scratch, chunks, small_batches, table
from .tokens import vocabulary

#: Fixed value: the pattern of the byte-level vocabulary's pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters after which a text is cut for the piece model, between a word and a space.
PIECE_CHARS = 200_000
#: Runs of white space that the fast library can't take go to the other one.
LONG_SPACE = re.compile(r"\s{20000}")
#: Links that one join makes at a time.
JOIN_LINKS = 2_000_000
#: Chunks, each a row of some ten megabytes, that a task writes or reads at once.
GROUP_CHUNKS = 2
#: Bits of a pair's key that hold the second id.
SECOND_BITS = 24

_pairs: dict[tuple[str, str], "TokenizerPair"] = {}


class TokenizerPair:
    """A byte-level BPE vocabulary (A) and a piece model (B), with every token's bytes."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        import tiktoken

        with open(byte_path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if spec.get("normalizer") or model.get("end_of_word_suffix") or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{byte_path} isn't a plain byte-level vocabulary")
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        entries = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items()}
        made = [entries[bytes(map(byte_of.__getitem__, "".join(m if isinstance(m, list) else m.split(" "))))] for m in model["merges"]]
        if made != sorted(made) or len({*made}) != len(made):
            raise ValueError(f"{byte_path}: ids don't follow the order of merges")
        self.byte_path, self.slow = byte_path, None
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=entries, special_tokens={})
        first = [b""] * (max(entries.values()) + 1)
        for data, i in entries.items():
            first[i] = data
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        #: Where no piece goes on with a space after another character, a text may be cut there.
        self.cuttable = not any(re.search("[^▁]▁", n) for n in names)
        second = [bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.bytes_a, self.bytes_b = pa.array(first, pa.binary()), pa.array(second, pa.binary())
        if len(second) >= 1 << SECOND_BITS:
            raise ValueError("the piece model has too many pieces")

    def first(self, text: str) -> list[int]:
        """Ids of A for space + text."""
        if len(text) >= 20_000 and LONG_SPACE.search(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.byte_path)
                self.slow.encode_special_tokens = True
            return self.slow.encode(" " + text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(" " + text)

    def second(self, texts: list[str]) -> list[list[int]]:
        """Ids of B for each text; B adds the space itself. Long texts go in parts that start with a space, which stands for the one added."""
        if not self.cuttable or all(len(t) <= PIECE_CHARS for t in texts):
            return self.pieces.encode(texts, num_threads=1)
        out = []
        for text in texts:
            ids: list[int] = []
            while len(text) > PIECE_CHARS and (cut := re.compile(r"[^ ▁] ").search(text, PIECE_CHARS - 1)):
                ids += self.pieces.encode(text[: cut.end() - 1])
                text = text[cut.end() :]
            # A part that is empty is a space at the text's end.
            out.append(ids + (self.pieces.encode(text) if text else [self.pieces.piece_to_id("▁")]))
        return out


def tokenizer_pair(byte_path: str, piece_path: str) -> TokenizerPair:
    """This worker's tokenizers; workers are reused."""
    if (byte_path, piece_path) not in _pairs:
        _pairs[byte_path, piece_path] = TokenizerPair(byte_path, piece_path)
    return _pairs[byte_path, piece_path]


def _lists(values: list[list[int]]) -> pa.ListArray:
    return pa.array(values, pa.list_(pa.int32()))


def _fit(lists: pa.ListArray, entries: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Whether each document's tokens, joined, are its text."""
    joined = pc.take(entries, lists.flatten())
    ends = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)[lists.offsets.to_numpy()] if len(joined) else np.zeros(len(texts) + 1, np.int64)
    data = memoryview(joined.buffers()[2] or b"").cast("B") if len(joined) else memoryview(b"")
    whole = b"".join(texts)
    if ends[-1] == len(whole) and data[: len(whole)] == whole and (np.diff(ends) == np.fromiter(map(len, texts), np.int64, len(texts))).all():
        return np.ones(len(texts), bool)
    return np.array([data[a:b] == t for a, b, t in zip(ends.tolist(), ends[1:].tolist(), texts)], bool)


def _joined(values: pa.Array, ends: np.ndarray, mark: str) -> pa.Array:
    """Strings of each stretch of ``values``, which ends at ``ends``, with ``mark`` between."""
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), mark)


def _links(group_a: np.ndarray, flat_a: pa.Array, group_b: np.ndarray, flat_b: pa.Array, document: np.ndarray) -> pa.Table:
    """document, pair (key), times: how often each document links each pair of ids.

    Groups of one token each need no join. Elsewhere equal ids of a group are counted first, so a
    long group of few ids stays small, and the join takes stretches of its links at a time.
    """
    size_a, size_b = np.bincount(group_a), np.bincount(group_b)
    single = (size_a == 1) & (size_b == 1)
    one_a, one_b = single[group_a], single[group_b]
    a, b = flat_a.to_numpy().astype(np.int64), flat_b.to_numpy().astype(np.int64)
    found = [pa.table({"document": document[group_a[one_a]], "pair": (a[one_a] << SECOND_BITS) + b[one_b], "times": np.ones(int(one_a.sum()), np.int64)})]
    left = pa.table({"group": group_a[~one_a], "a": a[~one_a]}).group_by(["group", "a"], use_threads=False).aggregate([([], "count_all")])
    right = pa.table({"group": group_b[~one_b], "b": b[~one_b]}).group_by(["group", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["group", "b", "count_b"])
    if left.num_rows:
        made = np.cumsum(np.bincount(right["group"].to_numpy(), minlength=len(size_b))[left["group"].to_numpy()])
        cuts = np.unique(np.searchsorted(made, np.arange(0, made[-1], JOIN_LINKS), side="right")).tolist()
        for begin, end in zip(cuts, [*cuts[1:], left.num_rows]):
            linked = left.slice(begin, end - begin).join(right, "group", join_type="inner", use_threads=False)
            times = linked["count_all"].to_numpy() * linked["count_b"].to_numpy()
            part = pa.table({"document": document[linked["group"].to_numpy()], "pair": (linked["a"].to_numpy() << SECOND_BITS) + linked["b"].to_numpy(), "times": times})
            found.append(part.group_by(["document", "pair"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["document", "pair", "times"]))
    return pa.concat_tables(found).group_by(["document", "pair"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["document", "pair", "times"])


def align_chunk(texts: list[str | None], tokenizers: TokenizerPair) -> tuple[dict[str, np.ndarray | list], pa.Table]:
    """Columns by document (n_a, n_b, n_groups, n_links, groups), and the links: document, pair, times."""
    n = len(texts)
    given = [i for i, t in enumerate(texts) if t]
    spaced = [(" " + texts[i]).encode() for i in given]
    lists_a, lists_b = _lists([tokenizers.first(texts[i]) for i in given]), _lists(tokenizers.second([texts[i] for i in given]))
    fit = _fit(lists_a, tokenizers.bytes_a, spaced) & _fit(lists_b, tokenizers.bytes_b, spaced)
    place = np.array(given, np.int64)[fit]
    lists_a, lists_b = lists_a.filter(pa.array(fit)), lists_b.filter(pa.array(fit))
    counts: dict[str, np.ndarray | list] = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    counts["groups"] = [""] * n
    if not len(place):
        return counts, pa.table({"document": np.zeros(0, np.int64), "pair": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)})
    flat_a, flat_b = lists_a.flatten(), lists_b.flatten()
    owner_a = pc.list_parent_indices(lists_a).to_numpy()
    # Documents lie one after the other, so a running sum of bytes is a key of document and end.
    end_a, end_b = (pc.cumulative_sum(pc.cast(pc.binary_length(pc.take(e, f)), pa.int64())) for e, f in ((tokenizers.bytes_a, flat_a), (tokenizers.bytes_b, flat_b)))
    both = pa.table({"end": end_a, "a": np.arange(len(end_a))}).join(pa.table({"end": end_b, "b": np.arange(len(end_b))}), "end", join_type="inner", use_threads=False)
    cut_a, cut_b = np.zeros(len(end_a), np.int64), np.zeros(len(end_b), np.int64)
    cut_a[both["a"].to_numpy()], cut_b[both["b"].to_numpy()] = 1, 1
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
    document = owner_a[last_a]
    counts["n_a"][place], counts["n_b"][place] = (pc.list_value_length(x).to_numpy() for x in (lists_a, lists_b))
    per_document = np.bincount(document, minlength=len(place))
    counts["n_groups"][place] = per_document
    sizes = np.bincount(group_a) * np.bincount(group_b)
    counts["n_links"][place] = np.add.reduceat(sizes, np.cumsum(per_document) - per_document)
    sides = pc.binary_join_element_wise(*(_joined(pc.cast(f, pa.string()), last + 1, ",") for f, last in ((flat_a, last_a), (flat_b, last_b))), "|")
    for i, text in zip(place.tolist(), _joined(sides, np.cumsum(per_document), ";")):
        counts["groups"][i] = text
    return counts, _links(group_a, flat_a, group_b, flat_b, place[document])


CHUNK_SCHEMA = (
    "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "pair array<long>, pair_documents array<long>, link_document array<int>, link_pair array<int>, link_times array<long>"
)


def align_documents(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row for each chunk of about two megabytes of text: columns by document, the chunk's
    distinct pairs with the number of its documents that link them, and its links as (document, pair, times)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizers, number = tokenizer_pair(byte_path, piece_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for begin, end in chunks(texts, lambda t: len(t or "")):
                counts, links = align_chunk(texts[begin:end], tokenizers)
                pairs = links.group_by("pair", use_threads=False).aggregate([([], "count_all")])
                index = pc.index_in(links["pair"], value_set=pairs["pair"].combine_chunks())
                digests = [hashlib.sha256(g.as_buffer()).hexdigest() if g else "" for g in counts["groups"]]
                columns = [ids.slice(begin, end - begin), *(counts[k] for k in ("n_a", "n_b", "n_groups", "n_links")), digests, pairs["pair"], pairs["count_all"], links["document"].cast(pa.int32()), index.cast(pa.int32()), links["times"]]
                lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in lists)], NAMES)
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CHUNK_SCHEMA)


NAMES = [c.split(" ")[0] for c in CHUNK_SCHEMA.split(", ")]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, documents (that link the pair, corpus-wide), best (highest of its a, ties included).

    Each chunk brings a pair once, with its own count, so no pair is hot; one a meets at most as
    many pairs as the second vocabulary has pieces.
    """
    pairs = aligned.select(F.explode(F.arrays_zip("pair", "pair_documents")).alias("p")).select("p.*")
    sums = pairs.groupBy("pair").agg(F.sum("pair_documents").alias("documents"))
    a, b = F.shiftright("pair", SECOND_BITS), F.col("pair").bitwiseAND(F.lit((1 << SECOND_BITS) - 1))
    most = F.max("documents").over(Window.partitionBy("a"))
    return sums.select("pair", a.alias("a"), b.alias("b"), "documents").withColumn("best", F.col("documents") == most)


def align_corpus(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Alignment by document (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and the pair counts.

    A text that is null, empty or whose tokens' bytes differ from space + text (as where B takes
    U+2581 for a space) has no tokens: zeros and an empty groups_sha256. Rows that share a doc_id
    are documents of their own, null ids stay null, other columns are ignored, an empty table gives
    no rows. Texts are read and tokenized once; what is written is a few numbers for each distinct
    pair of a document. Only distinct pairs of a chunk are shuffled.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    aligned = scratch.write(align_documents(docs, byte_path or vocabulary("byte_bpe_50k.json"), piece_path or vocabulary("piece_bpe_32k.model")), "chunks", GROUP_CHUNKS)
    counts = scratch.write(pair_counts(aligned), "pairs")
    wanted = aligned.select(F.col("chunk").alias("of_chunk"), F.posexplode("pair").alias("at", "pair"))
    totals = wanted.join(counts.select("pair", "documents", "best"), "pair").select("of_chunk", "at", "documents", "best")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(right["at"].to_numpy())
        documents, best = right["documents"].to_numpy()[order], right["best"].to_numpy()[order]
        for row in range(left.num_rows):
            one = {c: left[c].combine_chunks().slice(row, 1).flatten() for c in left.column_names if c != "chunk"}
            n = len(one["doc_id"])
            owner, pair, times = (one[c].to_numpy() for c in ("link_document", "link_pair", "link_times"))
            sums = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(sums[0], owner, times * best[pair])
            np.add.at(sums[1], owner, times * documents[pair])
            out.append(pa.table([*(one[c] for c in NAMES[1:6]), pa.array(sums[0]), pa.array(sums[1]), one["groups_sha256"]], [*NAMES[1:6], "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out) if out else EMPTY

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    EMPTY = pa.table({c.split(" ")[0]: pa.array([], pa.string() if c.endswith("string") else pa.int64()) for c in schema.split(", ")})
    scored = aligned.drop("pair", "pair_documents").groupBy("chunk").cogroup(totals.groupBy("of_chunk")).applyInArrow(score, schema)
    return scored, counts


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_corpus(table(spark, sf_dir, "documents"))[0]
