"""Exact token ids of the ``tokenizers`` library, one white-space separated word at a time.

The vocabulary file used here drops white space before it looks at words, and neither its
normaliser nor its pre-tokeniser looks across white space. So the ids of a text are the ids of
its words in a row, and each distinct word is encoded by the library once per worker and kept.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

#: Distinct words of one generation that a Python worker keeps.
MEMO_WORDS = 450_000
#: A word that is one token of its own; it parts the words of one library call.
SEPARATOR = b"0"
#: A lower-cased word: letters that neither NFC nor lower-casing changes any more, then ASCII marks
#: only, which are one pre-token; or anything else.
SIMPLE = re.compile("^(?:([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-/:-@\\[-`{-~]*)|.*)$", re.M)

_memos: dict[tuple[str, int], "WordEncoder"] = {}


def lowered(text: bytes) -> bytes:
    """``text`` with A-Z lower-cased, as the vocabulary's normaliser does, so that fewer words are different.

    Not where it could matter when that is done: before combining marks (U+0300 to U+036F), which
    are composed first, and in special tokens, whose names are matched as written.
    """
    return text if b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.lower()


class WordEncoder:
    def __init__(self, vocab: str, limit: int = MEMO_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.limit = limit
        # Two generations each: what is looked up moves to the new one, and the old one goes.
        self.memo: dict[bytes, bytes] = {}
        self.old_memo: dict[bytes, bytes] = {}
        self.full = Tokenizer.from_file(vocab)
        # For words that normalising leaves as they are and that are one pre-token, the same model
        # without those two steps.
        self.plain = Tokenizer.from_file(vocab)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.full.model.end_of_word_suffix
        if not suffix:
            raise ValueError(f"{vocab} doesn't mark where words end")
        entries = self.full.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(entries.values()) + 1, bool)
        self.is_end[[i for t, i in entries.items() if t.endswith(suffix)]] = True
        (self.separator_id,) = self._ids(self.full, SEPARATOR.decode())
        self.stems: dict[str, bytes] = {}
        self.old_stems: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    @staticmethod
    def _ids(tokenizer, text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    @staticmethod
    def _cut(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
        return map(ids.tobytes().__getitem__, map(slice, (4 * starts).tolist(), (4 * ends).tolist()))

    def _learn(self, words: list[bytes]) -> None:
        found = SIMPLE.findall(b"\n".join(words).decode().lower())
        if len(self.stems) >= self.limit:
            self.old_stems, self.stems = self.stems, {}
        stems, marks = self.stems, self.marks
        unknown = {stem for stem, _ in found if stem}.difference(stems)
        stems.update({stem: self.old_stems[stem] for stem in unknown & self.old_stems.keys()})
        self._learn_stems(sorted(unknown.difference(stems)))
        for mark in {mark for stem, mark in found if stem}.difference(marks):
            marks[mark] = np.array(self._ids(self.full, mark), "<u4").tobytes()
        self.memo.update([(w, stems[stem] + marks[mark]) for w, (stem, mark) in zip(words, found) if stem])
        other = [w for w, (stem, _) in zip(words, found) if not stem]
        self._learn_parted([w for w in other if SEPARATOR not in w])
        self._learn_singly([w for w in other if SEPARATOR in w])

    def _learn_stems(self, stems: list[str]) -> None:
        for begin in range(0, len(stems), 20_000):
            part = stems[begin : begin + 20_000]
            ids = np.array(self._ids(self.plain, " ".join(part)), "<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(part):
                self.stems.update(zip(part, self._cut(ids, np.concatenate([[0], ends[:-1]]), ends)))
            else:
                self.stems.update((s, np.array(self._ids(self.full, s), "<u4").tobytes()) for s in part)

    def _learn_parted(self, words: list[bytes]) -> None:
        for begin in range(0, len(words), 20_000):
            part = words[begin : begin + 20_000]
            ids = np.array(self._ids(self.full, (b" " + SEPARATOR + b" ").join(part).decode()), "<u4")
            cuts = np.flatnonzero(ids == self.separator_id)
            if len(cuts) == len(part) - 1:
                self.memo.update(zip(part, self._cut(ids, np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(ids)]]))))
            else:
                self._learn_singly(part)

    def _learn_singly(self, words: list[bytes]) -> None:
        found = self.full.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        self.memo.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(words, found))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text (null: none)."""
        # Nothing here makes cycles, and looking for them among so many new objects takes a sixth of the time.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[bytes | None]) -> list[bytes]:
        words = [lowered(t).split() if t else [] for t in texts]
        flat = list(chain.from_iterable(words))
        got = list(map(self.memo.get, flat))
        gaps = [i for i, g in enumerate(got) if g is None]
        if gaps:
            if len(self.memo) >= self.limit:
                self.old_memo, self.memo = self.memo, {}
                got = list(map(self.memo.get, flat))
                gaps = range(len(flat))
            memo, old, missing = self.memo, self.old_memo, set()
            for i in gaps:
                word = flat[i]
                known = old.get(word)
                if known is None:
                    missing.add(word)
                else:
                    memo[word] = got[i] = known
            if missing:
                missing.difference_update(memo)
                self._learn(list(missing))
                for i in gaps:
                    if got[i] is None:
                        got[i] = memo[flat[i]]
        out, at = [], 0
        for w in words:
            out.append(b"".join(got[at : at + len(w)]))
            at += len(w)
        return out


def word_encoder(vocab: str, limit: int = MEMO_WORDS) -> WordEncoder:
    """This worker's encoder for the vocabulary file; workers are reused, so words stay known."""
    key = (vocab, limit)
    if key not in _memos:
        _memos[key] = WordEncoder(vocab, limit)
    return _memos[key]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
