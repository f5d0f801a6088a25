"""Op 3: line labelling by a linear-chain conditional random field; content share decides retention."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, small_batches, table

#: Labelled documents that the model is fitted on at most, chosen by a hash of doc_id; all their lines count.
TRAIN_DOCS = 1000
#: Lines that fitting chains together; a longer document is several chains.
CHAIN = 64
#: Least share of a document's words that must stand in content lines.
CONTENT_SHARE = 0.5
#: Half the log-odds of content that a line starts from.
LEAN = 1.0

# Fixed values.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
CONTINUATION = bytes(range(0x80, 0xC0))
# Only what speaks against a line: a clean line has no more than the bias.
FEATURES = ("bias", "symbols", "many symbols", "capitals", "digits", "repeated line", "marks")
CONTENT, BOILERPLATE = 0, 1


def line_features(lines: list[bytes], words: list[list[bytes]]) -> np.ndarray:
    """A row of FEATURES for each line with a word."""
    seen: set[bytes] = set()
    rows = []
    for line, ws in zip(lines, words):
        n, k = len(line), len(ws)
        symbols = n - len(line.translate(None, SYMBOLS))
        capitals = n - len(line.translate(None, UPPER))
        digits = n - len(line.translate(None, DIGITS))
        marks = line.count(b"!") + line.count(b"=") + line.count(b"{") + line.count(b"}")
        again = line in seen
        seen.add(line)
        rows.append((1.0, symbols > 0.2 * k, symbols > k, capitals > 2 * k, digits > k, again, 2 * marks > k))
    return np.array(rows, np.float64).reshape(len(rows), len(FEATURES))


@dataclass
class LineField:
    """A chain over lines: score of a labelling = sum of emission rows and of transitions."""

    emission: np.ndarray  # FEATURES x 2
    transition: np.ndarray  # from, to

    def decode(self, scores: np.ndarray) -> list[int]:
        """Viterbi: the labelling of the highest total score; ties go to content."""
        rows = scores.tolist()
        if not rows:
            return []
        (cc, cb), (bc, bb) = self.transition.tolist()
        c, b = rows[0]
        back = []
        for sc, sb in rows[1:]:
            from_c = c + cc >= b + bc
            to_b = c + cb >= b + bb
            back.append((from_c, to_b))
            c, b = (c + cc if from_c else b + bc) + sc, (c + cb if to_b else b + bb) + sb
        label = CONTENT if c >= b else BOILERPLATE
        labels = [label]
        for step in reversed(back):
            label = CONTENT if step[label] else BOILERPLATE
            labels.append(label)
        return labels[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


#: The feature rows there can be: a line is the number of one of them. The bias is always there.
ROWS = np.array([[1, *map(int, f"{i:0{len(FEATURES) - 1}b}")] for i in range(2 ** (len(FEATURES) - 1))], np.float64)


def feature_codes(features: np.ndarray) -> np.ndarray:
    """Numbers in ROWS of feature rows."""
    return (features[:, 1:] @ 2 ** np.arange(len(FEATURES) - 2, -1, -1)).astype(np.uint8)


def fit(documents: list[np.ndarray], labels: list[int], rounds: int = 120, rate: float = 0.5, penalty: float = 1e-3) -> LineField:
    """Maximum likelihood by full-gradient steps; every line of a document (its feature codes) has the document's label.

    Rare classes weigh as much as common ones. The bias is not fitted: it leans to content, so that
    a line is boilerplate only for a reason. Without both labels everything is content.
    """
    model = LineField(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))
    model.emission[0] = (LEAN, -LEAN)
    keep = [i for i, x in enumerate(documents) if len(x)]
    counts = np.bincount([labels[i] for i in keep], minlength=2)
    if not counts.all():
        return model
    # Chains that are equal, with their labels, are one with more weight; a document counts once, however long.
    found: dict[tuple[bytes, int], float] = {}
    for i in keep:
        codes = documents[i]
        for begin in range(0, len(codes), CHAIN):
            key = (codes[begin : begin + CHAIN].tobytes(), labels[i])
            found[key] = found.get(key, 0.0) + 1 / (2 * counts[labels[i]] * len(codes))
    chains = sorted(found)
    longest = max(len(c) for c, _ in chains)
    code = np.zeros((len(chains), longest), np.int64)
    mask = np.zeros((len(chains), longest))
    for row, (c, _) in enumerate(chains):
        code[row, : len(c)] = np.frombuffer(c, np.uint8)
        mask[row, : len(c)] = 1
    lengths = mask.sum(axis=1).astype(int)
    weight = np.array([found[c] for c in chains])
    one = np.eye(2)[[y for _, y in chains]]
    per_line = weight[:, None] * mask
    by_code = lambda node: np.stack([np.bincount(code.ravel(), (per_line * node[..., k]).ravel(), len(ROWS)) for k in (0, 1)], axis=1)
    seen_emission = ROWS.T @ by_code(np.broadcast_to(one[:, None, :], (*code.shape, 2)))
    seen_transition = np.einsum("n,nj,nk->jk", weight * (lengths - 1), one, one)
    pair_mask = mask[:, 1:]
    last = np.arange(len(chains)), lengths - 1
    for _ in range(rounds):
        s = (ROWS @ model.emission)[code]
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(pair_mask[:, t - 1, None] > 0, s[:, t] + _logsum(alpha[:, t - 1, :, None] + model.transition, 1), alpha[:, t - 1])
        total = _logsum(alpha[last], 1)
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(pair_mask[:, t, None] > 0, _logsum(model.transition + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        node = np.exp(alpha + beta - total[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + model.transition + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pair_mask[..., None, None]
        step = seen_emission - ROWS.T @ by_code(node) - penalty * model.emission
        step[0] = 0
        model.emission += 4 * rate * step
        model.transition += rate * (seen_transition - np.einsum("n,nljk->jk", weight, pair) - penalty * model.transition)
    return model


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words in windows that are found twice or more in the text, the first find included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    code = ids[:n]
    for k in range(1, window):
        code = code * len(index) + ids[k : k + n]
        if len(index) ** (k + 2) >= 2**62:  # the next step could pass 63 bits
            code = np.unique(code, return_inverse=True)[1]
    _, place, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[place] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + n] |= again
    return int(covered.sum())


def line_parts(text: bytes) -> tuple[list[bytes], list[list[bytes]]]:
    """The \\n-split lines that have a word, and their words."""
    lines = text.split(b"\n")
    words = [line.split() for line in lines]
    return [x for x, w in zip(lines, words) if w], [w for w in words if w]


def base_counts(text: bytes, lines: list[bytes], words: list[list[bytes]]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    flat = [w for ws in words for w in ws]
    return (
        len(flat),
        len(text.translate(None, SPACES + CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(flat),
    )


def train_field(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> LineField:
    """Fits the field on at most ``limit`` labelled documents: quality 0 stands for boilerplate lines."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, quality in zip(*(batch.column(c).to_pylist() for c in range(2))):
                data = feature_codes(line_features(*line_parts(text or b""))).tobytes()
                yield pa.RecordBatch.from_pydict({"data": pa.array([data], pa.binary()), "quality": pa.array([quality], pa.int64())})

    found = sorted(rows.mapInArrow(run, "data binary, quality long").collect())
    return fit([np.frombuffer(bytes(r.data), np.uint8) for r in found], [CONTENT if r.quality else BOILERPLATE for r in found])


def quality_rules(docs: DataFrame, labels: DataFrame, min_words: int = 50, max_repeat_pct: int = 50, content_share: float = CONTENT_SHARE, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, content_words, n_lines, content_lines.

    Lines with a word are labelled content or boilerplate by Viterbi decoding of a chain fitted on
    ``labels`` (doc_id, quality); kept: the base rules hold and content lines have at least
    ``content_share`` of the words. Null and empty texts have no words and fail the base rules.
    Each row is judged on its own, so repeated rows get equal results. Without labels of both
    qualities every line is content. An empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    judge = text_judge(train_field(docs, labels, train_docs), min_words, max_repeat_pct, content_share)
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "content_words": pa.int64(), "n_lines": pa.int64(), "content_lines": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in chunks(texts, lambda t: len(t or b"")):
                rows = [(i, *judge(t or b"")) for i, t in zip(ids[a:b], texts[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))

    schema = ", ".join(f"{n} {'boolean' if k == pa.bool_() else 'long'}" for n, k in kinds.items())
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)


def text_judge(field: LineField, min_words: int = 50, max_repeat_pct: int = 50, content_share: float = CONTENT_SHARE):
    """A function from a UTF-8 text to the result columns after doc_id."""

    def judge(text: bytes) -> tuple:
        lines, words = line_parts(text)
        counts = base_counts(text, lines, words)
        labelled = field.decode(line_features(lines, words) @ field.emission)
        content = sum(len(w) for w, y in zip(words, labelled) if y == CONTENT)
        failed = counts[0] < min_words or 100 * counts[4] > max_repeat_pct * counts[0]
        return (*counts, failed, not failed and content >= content_share * counts[0], content, len(lines), labelled.count(CONTENT))

    return judge


def kept_documents(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality_rules`` keeps; nothing is shuffled."""
    small_batches(docs.sparkSession)
    judge = text_judge(train_field(docs, labels, train_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield batch.filter(pa.array([judge((t or "").encode())[6] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
