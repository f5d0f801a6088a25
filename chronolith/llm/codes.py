"""Op 13: product codes of vectors by whole-number clustering in the Walsh-Hadamard domain.

A part of a vector and a codebook entry are zero-padded to a power of two and transformed by the
integer Walsh-Hadamard transform. Squared differences of the m coefficients sum to m times the
squared distance, so they can be added coefficient by coefficient, low sequency first, and an entry
is dropped as soon as its sum passes that of the best finished one. No number is ever rounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components beyond this, on either side, count as this.
FARTHEST = 2.0**100
#: Sums are moved as high * 2**LIMB + low, so that they fit at any size.
LIMB = 40
#: Vectors that a task works on together.
BLOCK = 4096
#: Largest number of labels whose sums are sent to all tasks.
BROADCAST_LABELS = 1_000_000
#: Places over which one label's rows are spread when labels are too many for that.
SALTS = 32
LONG_MAX = np.iinfo(np.int64).max

Codebooks = list[list[list[int]]]


def sequency_matrix(m: int) -> np.ndarray:
    """The Hadamard matrix of order ``m`` (a power of two), its rows by number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < m:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")]


def transform(values: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, zero-padded, as columns: row k holds coefficient k of all, in sequency order."""
    width = values.shape[1]
    h = sequency_matrix(1 << max(0, width - 1).bit_length())[:, :width]
    return h.astype(values.dtype) @ values.T


def typed(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as longs where every sum below fits into one, else as Python's whole numbers."""
    m = 1 << max(0, values.shape[1] - 1).bit_length()
    largest = max((int(abs(x).max()) for x in (values, entries) if x.size), default=0)
    kind = np.int64 if 4 * m**3 * largest**2 < LONG_MAX else object
    return values.astype(kind), entries.astype(kind)


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry (ties to the lower index) and the squared distance, exactly."""
    values, entries = typed(values, entries)
    columns, targets = transform(values), transform(entries)
    m, n, k = len(columns), len(values), len(entries)
    rows = np.arange(n)
    # The entry that is nearest by the first coefficients is finished first and bounds the others.
    lead = min(m, max(1, m // 4))
    sums = np.zeros((k, n), values.dtype)
    for c in range(lead):
        sums += (columns[c] - targets[c][:, None]) ** 2
    guess = np.argmin(sums, axis=0)
    best = sums[guess, rows].copy()
    for c in range(lead, m):
        best += (columns[c] - targets[c][guess]) ** 2
    owner = guess.copy()
    at, who = np.nonzero(sums <= best)  # entry, row
    partial = sums[at, who]
    other = at != guess[who]
    at, who, partial = at[other], who[other], partial[other]
    for c in range(lead, m):
        partial = partial + (columns[c][who] - targets[c][at]) ** 2
        alive = partial <= best[who]
        at, who, partial = at[alive], who[alive], partial[alive]
    if len(who):  # what is left is at least as near as the guess: smallest sum, then lowest index
        order = np.lexsort((at, partial, who)) if partial.dtype != object else np.array(sorted(range(len(who)), key=lambda i: (who[i], partial[i], at[i])))
        at, who, partial = at[order], who[order], partial[order]
        first = np.concatenate([[True], who[1:] != who[:-1]])
        at, who, partial = at[first], who[first], partial[first]
        better = (partial < best[who]) | ((partial == best[who]) & (at < owner[who]))
        owner[who[better]], best[who[better]] = at[better], partial[better]
    return owner, best // m


def whole_components(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles; Python's whole numbers where a long is too short."""
    scaled = np.floor(np.clip(vectors * float(scale), -FARTHEST, FARTHEST))
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        return np.frompyfunc(int, 1, 1)(scaled)
    return scaled.astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK):
            yield pa.Table.from_batches([batch.slice(begin, BLOCK)])


def _sums(vectors: DataFrame, width: int, books: Codebooks, scale: int) -> DataFrame:
    """part, entry, place, n, high, low: how many parts each task gave to an entry, and their sums by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = width // len(books)
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros((len(b), step), object) for b in books]
        for found in _batches(batches):
            values = whole_components(_matrix(found["v"].combine_chunks(), width), scale)
            for p, book in enumerate(books):
                part = values[:, p * step : (p + 1) * step]
                owner, _ = nearest(part, np.array(book, object))
                counts[p] += np.bincount(owner, minlength=len(book))
                order = np.argsort(owner, kind="stable")
                used, starts = np.unique(owner[order], return_index=True)
                exact = part.astype(object) if part.dtype != object and int(abs(part).max()) >= 2**48 else part
                totals[p][used] += np.add.reduceat(exact[order], starts, axis=0).astype(object)
        rows = [(p, e, d, int(counts[p][e]), int(totals[p][e, d]) >> LIMB, int(totals[p][e, d]) & (1 << LIMB) - 1) for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist() for d in range(step)]
        yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(("part", "entry", "place", "n", "high", "low"))})

    return vectors.mapInArrow(run, "part long, entry long, place long, n long, high long, low long").groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))


def fit_codebooks(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks by part: whole-number clustering of all ``vectors`` (vec_id, v), from the parts of the smallest vec_ids.

    The driver holds codebooks and one sum for each of their components, and nothing that grows with the rows.
    """
    seeds = vectors.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    first = whole_components(_matrix(seeds, width), scale) if len(seeds) else np.zeros((0, width), np.int64)
    step = width // parts
    books: Codebooks = [[[int(x) for x in row] for row in first[:, p * step : (p + 1) * step]] for p in range(parts)]
    if not len(first):
        return books
    for _ in range(rounds):
        for r in _sums(vectors, width, books, scale).collect():
            books[r["part"]][r["entry"]][r["place"]] = ((r["high"] << LIMB) + r["low"]) // r["n"]
    return books


def digest(books: Codebooks) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, width: int, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``vectors`` (with v) plus code (array of entry indexes by part) and error (squared distance, summed over parts)."""
    kept = [c for c in vectors.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = width // len(books)
        for found in _batches(batches):
            values = whole_components(_matrix(found["v"].combine_chunks(), width), scale)
            codes = np.zeros((len(values), len(books)), np.int32)
            errors = np.zeros(len(values), object)
            for p, book in enumerate(books):
                codes[:, p], distance = nearest(values[:, p * step : (p + 1) * step], np.array(book, object))
                errors += distance.astype(object)
            offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(books))
            new = [pa.ListArray.from_arrays(offsets, pa.array(codes.reshape(-1))), pa.array([min(e, LONG_MAX) for e in errors.tolist()], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(found[c].combine_chunks() for c in kept), *new], [*kept, "code", "error"])

    fields = [*(f for f in vectors.schema.fields if f.name != "v"), T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())]
    return vectors.mapInArrow(run, T.StructType(fields))


def compress_vectors(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code, error of every vector that can be coded, and the codebooks.

    Components become floor(scale * x). Rows whose vector is null or empty, or holds null or
    non-finite components, are dropped. All vectors must have one length, a multiple of ``parts``;
    otherwise ValueError. Rows with a null vec_id are coded and take part in the averages, but
    start no entry; without any vec_id there are no entries and no rows. Rows that share a vec_id
    stay rows of their own, the first entries taking them by vector; fewer rows than ``entries``
    make smaller codebooks. Components beyond 2**100 count as that, an error beyond a long as the
    largest long. Other columns are ignored. A round is one pass and moves one row for each
    component of the codebooks from each task; the vectors are written once, in the shared folder.
    """
    spark = embeddings.sparkSession
    clean = embeddings.where("embedding is not null and size(embedding) > 0").where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    scratch = Scratch(spark, "vectors")
    vectors = scratch.write(clean.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v")), "vectors")
    low, high = vectors.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if low is not None and (low != high or low % parts):
        raise ValueError(f"vectors have {low} to {high} components; one length, a multiple of {parts}, is asked for")
    books = fit_codebooks(vectors, low or parts, parts, entries, rounds, scale)
    if not books[0]:
        vectors = vectors.limit(0)
    return encode_vectors(vectors, low or parts, books, scale), books


def error_by_label(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the errors' sum over rows of the same label (nulls are one label).

    Sums are broadcast if a count shows that they are few; else rows of a label are spread over
    SALTS places, so that no label is one task's.
    """
    limit = F.lit(LONG_MAX).cast("decimal(38,0)")
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")), limit).cast("long").alias("label_error"))
    sums = sums.withColumnRenamed("label", "of_label")
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), coded["label"].eqNullSafe(sums["of_label"])).drop("of_label")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    spread = sums.withColumn("of_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return salted.join(spread, F.col("label").eqNullSafe(F.col("of_label")) & (F.col("salt") == F.col("of_salt"))).drop("of_label", "of_salt", "salt")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    found = error_by_label(Scratch(spark, "codes").write(coded, "coded"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return found.select("vec_id", code.alias("code"), "error", F.col("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same result in DuckDB SQL: rounds are written out, distances by plain differences."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT x.n, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{k} c USING (part, place) GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT n, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM d{k} GROUP BY n, part)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT part, a.entry, place, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM x JOIN a{k} a USING (n, part) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.place, coalesce(((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::BIGINT, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (part, entry, place))""")
    return f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS n, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT n, unnest(embedding) AS f, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // {parts} AS step FROM e),
x AS MATERIALIZED (SELECT n, i // step AS part, i % step AS place, floor({scale} * f::DOUBLE)::BIGINT AS v FROM w),
c0 AS MATERIALIZED (SELECT part, n - 1 AS entry, place, v FROM x WHERE n <= {entries}),
{", ".join(steps)},
r AS (SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY n),
h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN e USING (n) CROSS JOIN h
"""
