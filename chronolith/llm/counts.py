"""Op 4: token-count rollups kept up to date by signed deltas, with idempotent batch commits."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, fresh_path, materialise, small_batches, table
from .tokens import vocabulary, word_encoder

KEYS = ("source", "lang", "tokenizer")
WORDS, BPE = "words@1", "word_bpe_49k@1"


def count_tokens(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """doc_id, source, lang, n_chars, has_text, n_words and n_bpe of each whole text (null: none)."""
    vocab = vocab or vocabulary()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocab)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            words, bpe = [], []
            for a, b in chunks(texts, lambda t: len(t or b"")):
                words += [len(t.split()) if t else 0 for t in texts[a:b]]
                bpe += [len(x) // 4 for x in encoder.encode(texts[a:b])]
            kept = [batch.column(c) for c in ("doc_id", "source", "lang", "n_chars")]
            has_text = pa.array([t is not None for t in texts])
            yield pa.RecordBatch.from_arrays([*kept, has_text, pa.array(words, pa.int64()), pa.array(bpe, pa.int64())], ["doc_id", "source", "lang", "n_chars", "has_text", "n_words", "n_bpe"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(run, "doc_id long, source string, lang string, n_chars long, has_text boolean, n_words long, n_bpe long")


def inserts(rows: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).alias("docs"), tokens.cast("long").alias("tokens"))


def deletes(rows: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(-1).alias("docs"), (-tokens).cast("long").alias("tokens"))


def revisions(rows: DataFrame, tokenizer: str, before: Column, after: Column) -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).alias("docs"), (after - before).cast("long").alias("tokens"))


def moves(rows: DataFrame, tokenizer: str, before: tuple[Column, Column, Column], after: tuple[Column, Column, Column]) -> DataFrame:
    """Revisions that may change source and language too; ``before`` and ``after`` are (source, language, tokens)."""
    sides = [rows.select(s.cast("string").alias("source"), l.cast("string").alias("lang"), t.cast("long").alias("n")) for s, l, t in (before, after)]
    return deletes(sides[0], tokenizer, F.col("n")).unionByName(inserts(sides[1], tokenizer, F.col("n")))


TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"


class TokenRollup:
    """Additive totals by source, language and tokenizer version in a folder of committed batches.

    A batch's sums are written to a data folder of their own; the commit is the renaming of a small
    marker, which names that folder, to the batch's id. That happens whole or not at all, and only
    for the first of several writers, so retries, replays and rivals count once, in any order, and
    what a failed attempt leaves is read by nobody. The totals are maintained as a snapshot, which
    ``compact`` brings up to date and commits in the same way; reading adds the batches that came
    after it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self):
        fs = self.spark._jvm.org.apache.hadoop.fs
        return fs, fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, store = self._hadoop()
        root = fs.Path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in store.listStatus(root)) if store.exists(root) else []

    def _delete(self, name: str) -> None:
        fs, store = self._hadoop()
        store.delete(fs.Path(f"{self.path}/{name}"), True)

    def _read(self, marker: str) -> list[str]:
        """Lines of a marker."""
        fs, store = self._hadoop()
        stream = store.open(fs.Path(f"{self.path}/{marker}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        finally:
            stream.close()

    def _mark(self, marker: str, lines: list[str]) -> bool:
        """Puts a marker in place whole; False if another has been first."""
        fs, store = self._hadoop()
        draft, target = fs.Path(f"{self.path}/drafts/{uuid.uuid4().hex}"), fs.Path(f"{self.path}/{marker}")
        store.mkdirs(target.getParent())
        stream = store.create(draft, False)
        stream.write(bytearray("\n".join(lines).encode()))
        stream.close()
        context = fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(target), self.spark._sc._gateway.new_array(getattr(fs, "Options$Rename"), 0))
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception.getClass()):
                raise
            store.delete(draft, False)
            return False
        return True

    def _sums(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(TOTALS).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], TOTALS)
        return rows.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds a batch of deltas (source, lang, tokenizer, docs, tokens); False if it is committed already."""
        if not re.fullmatch(r"[A-Za-z0-9.-]+", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if batch_id in self.batches():
            return False
        folder = f"data/{batch_id}-{uuid.uuid4().hex}"
        deltas.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens")).write.parquet(f"{self.path}/{folder}")
        if self._mark(f"commits/{batch_id}", [folder]):
            return True
        self._delete(folder)
        return False

    def batches(self) -> list[str]:
        return self._names("commits")

    def _state(self) -> tuple[int, list[str], list[str]]:
        """Number of the latest snapshot, the batches in it, and the folders that make up the totals."""
        done = self._names("snapshots")
        folder, included = "", []
        if done:
            folder, *included = self._read(f"snapshots/{done[-1]}")
        fresh = sorted(set(self.batches()).difference(included))
        return len(done), [*included, *fresh], [f for f in [folder, *(self._read(f"commits/{b}")[0] for b in fresh)] if f]

    def compact(self) -> bool:
        """Folds all batches into a new snapshot; False if there is nothing new or another was first."""
        number, included, folders = self._state()
        if len(folders) < 2 and number or not folders:
            return False
        folder = f"data/snapshot-{uuid.uuid4().hex}"
        self._sums(folders).where("docs <> 0 OR tokens <> 0").write.parquet(f"{self.path}/{folder}")
        if self._mark(f"snapshots/{number:012d}", [folder, *included]):
            return True
        self._delete(folder)
        return False

    def vacuum(self) -> int:
        """Removes data that the totals no longer need, or never did; to be run when nothing reads or writes."""
        needed = {f.removeprefix("data/") for f in self._state()[2]}
        gone = [n for n in self._names("data") if n not in needed]
        for name in gone:
            self._delete(f"data/{name}")
        return len(gone)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; combinations that have come to nothing are left out."""
        summed = self._sums(self._state()[2])
        return summed.withColumnsRenamed({"docs": "n_docs", "tokens": "n_tokens"}).where("n_docs <> 0 OR n_tokens <> 0")


def roll_up(docs: DataFrame, path: str, vocab: str | None = None) -> DataFrame:
    """Totals of all documents after a load in four batches, two of which are sent again, and a compaction on the way.

    Words are counted at once; BPE counts start from a guess by n_chars, which a later batch
    revises to the exact ones; documents without text are deleted again. Null source and language
    are groups of their own, null n_chars guesses nothing, repeated rows count as often as they
    come, an empty table gives no rows and other columns are ignored. A source with a third of the
    rows is summed in each task first.
    """
    counts = materialise(count_tokens(docs, vocab), "token-counts")
    guess = F.ceil(F.coalesce("n_chars", F.lit(0)) / 4)
    gone = counts.where("NOT has_text")
    rollup = TokenRollup(docs.sparkSession, path)
    load = [
        ("words", inserts(counts, WORDS, F.col("n_words"))),
        ("bpe-guess", inserts(counts, BPE, guess)),
        ("bpe-exact", revisions(counts, BPE, guess, F.col("n_bpe"))),
        ("gone", deletes(gone, WORDS, F.col("n_words")).unionByName(deletes(gone, BPE, F.col("n_bpe")))),
    ]
    for batch_id, deltas in load[:2]:
        rollup.commit(batch_id, deltas)
    rollup.compact()
    for batch_id, deltas in [*load[1:], load[2]]:
        rollup.commit(batch_id, deltas)
    return rollup.totals()


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll_up(table(spark, sf_dir, "documents"), fresh_path(spark, "token-rollup"))
