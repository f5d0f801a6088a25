"""Op 12: byte-pair encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks the pairs of neighbours up by binary
search over the sorted pair keys of the merge list, finds the lowest rank of each word and merges
every place where a word has it. Words that hold no pair of the list any more leave the array.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, small_batches, table
from .tokens import lowered, vocabulary

#: Distinct words of one generation that a Python worker keeps.
MEMO_WORDS = 300_000
#: Words that are normalised and cut by one call.
LEARN_WORDS = 20_000
#: Bytes of a pre-token from which its rounds are run by themselves, on linked symbols.
LONG_PIECE = 2_000
#: White space other than a space; the words here hold none of ASCII's.
ODD_SPACE = re.compile(r"[^\S ]")
#: Rank of a pair that the merge list doesn't have.
NONE = np.iinfo(np.int32).max

_encoders: dict[tuple[str, int], "PairEncoder"] = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, else from U+0100 on in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class PairEncoder:
    """Ids of texts, and texts of ids, for a vocabulary file whose pre-tokens don't reach across ASCII white space."""

    def __init__(self, path: str, limit: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError(f"{path} asks for steps that aren't built here")
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]) or any(c.isspace() for t in added for c in t):
            raise ValueError(f"{path}: added tokens must be matched as written")
        self.limit = limit
        self.size = max([*vocab.values(), *added.values()]) + 1
        tokens: list[str] = [""] * self.size
        for token, i in chain(vocab.items(), added.items()):
            tokens[i] = token
        #: Each token's text and the space that a decoder-less vocabulary puts between tokens.
        self.spaced = pa.array([t.encode() + b" " for t in tokens], pa.binary())
        characters = byte_characters()
        self.inner = np.zeros(0x200, np.int32)
        self.last = np.zeros(0x200, np.int32)
        for c in characters:
            self.inner[ord(c)], self.last[ord(c)] = vocab[c], vocab[c + suffix]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # Merging in whole rounds is right only if no pair precedes the merge that makes one of its sides.
        made = np.full(self.size, -1)
        made[merged[::-1]] = np.arange(len(pairs))[::-1]
        if (np.maximum(made[left], made[right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path}: a pair precedes the merge that makes one of its sides")
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int32), merged[order]
        #: Whether A-Z may be lower-cased before words are looked up, as the file's normaliser does it anyway.
        self.lowers = (spec.get("normalizer") or {}).get("normalizers", [{}])[-1].get("type") == "Lowercase"
        full = Tokenizer.from_file(path)
        self.normalizer, self.splitter = full.normalizer, full.pre_tokenizer
        self.added = {t.encode(): np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if added else None
        # Two generations: what is looked up moves to the new one, and the old one goes.
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    # Pairs and rounds

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where the list doesn't have the pair) and place in the sorted keys."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row and how many each has; ``lengths`` (all positive) part ``symbols`` into pieces."""
        counts, where, ids = np.zeros(len(lengths), np.int64), [], []
        piece = np.repeat(np.arange(len(lengths)), lengths)
        long = np.flatnonzero(lengths >= LONG_PIECE)
        if len(long):
            starts = np.cumsum(lengths) - lengths
            for k in long.tolist():
                found = self.merge_linked(symbols[starts[k] : starts[k] + lengths[k]])
                counts[k] = len(found)
                where.append(np.full(len(found), k))
                ids.append(found)
            short = lengths[piece] < LONG_PIECE
            symbols, piece = symbols[short], piece[short]
        symbols = symbols.copy()
        rank, at = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
        inside = np.flatnonzero(piece[1:] == piece[:-1])
        rank[inside], at[inside] = self.look_up(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            sizes = np.diff(np.append(starts, len(symbols)))
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                out = np.repeat(done, sizes)
                where.append(piece[out])
                ids.append(symbols[out])
                counts[piece[starts[done]]] = sizes[done]
                symbols, piece, rank, at = (x[~out] for x in (symbols, piece, rank, at))
                best, sizes = best[~done], sizes[~done]
                if not len(symbols):
                    break
            places = np.flatnonzero(rank == np.repeat(best, sizes))
            touching = np.concatenate([[False], np.diff(places) == 1])
            if touching.any():  # equal symbols in a row: every other place, from the left
                number = np.arange(len(places))
                run = np.maximum.accumulate(np.where(touching, 0, number))
                places = places[(number - run) % 2 == 0]
            symbols[places] = self.merged[at[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            places = places - np.arange(len(places))  # where they are once the others have gone
            symbols, piece, rank, at = (x[keep] for x in (symbols, piece, rank, at))
            changed = np.concatenate([places, places[places > 0] - 1])
            rank[changed] = NONE
            changed = changed[changed + 1 < len(symbols)]
            changed = changed[piece[changed] == piece[changed + 1]]
            rank[changed], at[changed] = self.look_up(symbols[changed], symbols[changed + 1])
        order = np.argsort(np.concatenate(where), kind="stable") if where else np.zeros(0, np.int64)
        return (np.concatenate(ids)[order] if ids else symbols), counts

    def merge_linked(self, symbols: np.ndarray) -> np.ndarray:
        """One long piece: rounds over linked symbols, which touch only the places that change."""
        symbols, n = symbols.copy(), len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, at = np.full(n, NONE), np.zeros(n, np.int64)
        rank[:-1], at[:-1] = self.look_up(symbols[:-1], symbols[1:])
        live = np.ones(n, bool)
        queue = rank.copy()
        index = np.arange(n)
        while len(queue) and (best := queue.min()) != NONE:
            places = index[queue == best]
            chosen, last = [], -1
            if len(places) > 1 and (after[places[:-1]] == places[1:]).any():
                for p in places.tolist():
                    if p != last:
                        chosen.append(p)
                        last = int(after[p])
                    else:
                        last = -1
                places = np.array(chosen)
            gone = after[places]
            symbols[places] = self.merged[at[places]]
            live[gone] = False
            rank[gone] = NONE
            after[places] = after[gone]
            linked = after[places] < n
            before[after[places][linked]] = places[linked]
            changed = np.unique(np.concatenate([places, before[places]]))
            changed = changed[changed >= 0]
            rank[changed] = NONE
            changed = changed[after[changed] < n]
            rank[changed], at[changed] = self.look_up(symbols[changed], symbols[after[changed]])
            if live.sum() * 2 < len(index):
                index = np.flatnonzero(live)
                queue = rank[index]
            else:
                queue = rank[index]
        return symbols[live]

    # Words

    def _cut(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of the words in a row, and how many each has; both steps are the vocabulary file's own."""
        joined = " ".join(words)
        odd = len(words) > 1 and ODD_SPACE.search(joined)
        normal = self.normalizer.normalize_str(joined) if self.normalizer and not odd else joined
        parts = normal.split(" ")
        if odd or 1 < len(words) != len(parts):  # such words are looked at one by one
            half = len(words) // 2
            (a, m), (b, n) = self._cut(words[:half]), self._cut(words[half:])
            return a + b, np.concatenate([m, n])
        if len(words) == 1:
            pieces = [p for p, _ in self.splitter.pre_tokenize_str(normal)]
            return pieces, np.array([len(pieces)])
        starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        pieces = self.splitter.pre_tokenize_str(normal)
        owner = np.searchsorted(starts, [span[0] for _, span in pieces], side="right") - 1
        return [p for p, _ in pieces], np.bincount(owner, minlength=len(words)) if pieces else np.zeros(len(words), np.int64)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of words without ASCII white space and without added tokens."""
        pieces, counts = self._cut([w.decode() for w in words])
        if not pieces:
            return [b""] * len(words)
        letters = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.inner[letters]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[letters[ends]]
        ids, per_piece = self.merge(symbols, lengths)
        piece_ends = np.concatenate([[0], np.cumsum(per_piece)])
        cuts = (4 * piece_ends[np.concatenate([[0], np.cumsum(counts)])]).tolist()
        data = ids.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, words: list[bytes]) -> None:
        marked = [w for w in words if self.special and self.special.search(w)]
        parted = {w: self.special.split(w) for w in marked}
        plain = [*set(words).difference(marked), *{p for parts in parted.values() for p in parts if p and p not in self.added}]
        known: dict[bytes, bytes] = {}
        for begin in range(0, len(plain), LEARN_WORDS):
            part = plain[begin : begin + LEARN_WORDS]
            known.update(zip(part, self.encode_words(part)))
        for word, parts in parted.items():
            known[word] = b"".join(self.added.get(p) or known[p] for p in parts if p)
        self.memo.update((w, known[w]) for w in words)

    # Texts

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text (null: none)."""
        # Nothing here makes cycles; looking for them among so many new objects takes long.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[bytes | None]) -> list[bytes]:
        words = [(lowered(t) if self.lowers else t).split() if t else [] for t in texts]
        flat = list(chain.from_iterable(words))
        got = list(map(self.memo.get, flat))
        gaps = [i for i, g in enumerate(got) if g is None]
        if gaps:
            if len(self.memo) >= self.limit:
                self.old, self.memo = self.memo, {}
                got, gaps = [None] * len(flat), range(len(flat))
            missing = {flat[i] for i in gaps}
            kept = missing & self.old.keys()
            self.memo.update((w, self.old[w]) for w in kept)
            missing -= kept
            if missing:
                self._learn(list(missing))
            for i in gaps:
                got[i] = self.memo[flat[i]]
        out, at = [], 0
        for w in words:
            out.append(b"".join(got[at : at + len(w)]))
            at += len(w)
        return out

    def decode(self, ids: list[bytes | None]) -> list[bytes]:
        """UTF-8 texts of ids: the tokens' own texts with a space between, as a vocabulary without a decoder gives them; unknown ids are skipped."""
        flat = np.frombuffer(b"".join(i or b"" for i in ids), "<u4")
        ends = np.cumsum([0, *(len(i or b"") // 4 for i in ids)])
        if len(flat) and int(flat.max()) >= self.size:
            known = flat < self.size
            flat, ends = flat[known], np.concatenate([[0], np.cumsum(known)])[ends]
        texts = pc.take(self.spaced, pa.array(flat))
        cuts = np.frombuffer(texts.buffers()[1], np.int32, len(flat) + 1)[ends].tolist() if len(flat) else [0] * len(ends)
        data = memoryview(texts.buffers()[2] or b"") if len(flat) else memoryview(b"")
        return [bytes(data[a : max(a, b - 1)]) for a, b in zip(cuts, cuts[1:])]


def pair_encoder(path: str, limit: int = MEMO_WORDS) -> PairEncoder:
    """This worker's encoder for the vocabulary file; workers are reused, so words stay known."""
    if (path, limit) not in _encoders:
        _encoders[path, limit] = PairEncoder(path, limit)
    return _encoders[path, limit]


def _mapped(df: DataFrame, source: str, target: str, change) -> DataFrame:
    """``df`` with the binary column ``target`` made from the binary column ``source``, a few megabytes at a time."""
    names = [*df.columns, target]
    size = 4_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(source)).to_pylist()
            for a, b in chunks(values, lambda v: len(v or b""), size):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(change(values[a:b]), pa.binary())], names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(target, T.BinaryType())]))


def encode_documents(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, binary) and n_tokens of each document's whole text.

    One row for each row of ``docs``, with no shuffle; null and empty texts have no ids, rows that
    share a doc_id stay rows of their own, other columns are ignored. Special tokens' names inside
    texts are those tokens, as the library has it.
    """
    vocab = vocab or vocabulary()
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = _mapped(texts, "text", "ids", lambda values: pair_encoder(vocab).encode(values))
    return found.select("doc_id", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"))


def decode_documents(encoded: DataFrame, vocab: str | None = None) -> DataFrame:
    """``encoded`` with the decoded text of its column ids as UTF-8 (``decoded``, binary); null ids give an empty text."""
    vocab = vocab or vocabulary()
    return _mapped(encoded, "ids", "decoded", lambda values: pair_encoder(vocab).decode(values))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode_documents(encode_documents(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
