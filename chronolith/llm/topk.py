"""Op 2: exact top-k by columnar branch-and-bound over blocks of dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialise, small_batches, table

#: Dimensions whose products are added before candidates are bounded and compacted again.
DIM_BLOCK = 16
#: Candidates and queries that are worked on together.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 64
#: Bytes of query vectors that one wave sends to every task; more queries take more waves.
WAVE_BYTES = 32_000_000
#: Candidates that are searched first; what they give for each query bounds the search of all others.
SEED_ROWS = 200_000
#: Score of a place that no candidate has taken.
EMPTY = np.iinfo(np.int64).min
#: Scores beyond these count as these.
LOWEST, HIGHEST = EMPTY + 1, np.iinfo(np.int64).max


def _typed(queries: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the narrowest numbers that hold every sum of products exactly: doubles, longs or Python's."""
    largest = float(np.abs(queries).max()) * float(np.abs(columns).max()) * len(columns)
    if largest < 2.0**52:
        return queries, columns
    if largest < 2.0**62:
        return queries.astype(np.int64), columns.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(queries), whole(columns)


def top_block(queries: np.ndarray, query_rows: np.ndarray, columns: np.ndarray, rows: np.ndarray, ids: np.ndarray, floors: np.ndarray, scores: np.ndarray, owners: np.ndarray) -> None:
    """Merges a block of candidates into ``scores`` and ``owners`` (the best k of each query, in place).

    ``columns`` holds the candidates in vertical layout: a row for each dimension. After each block
    of dimensions a candidate's score is at most its partial sum plus the product of the norms of
    what remains (Cauchy-Schwarz); those that can't reach the k-th best score, or the query's floor,
    are compacted away. All numbers are whole.
    """
    queries, columns = _typed(queries, columns)
    dims, k = len(columns), scores.shape[1]
    cuts = [*range(DIM_BLOCK, dims, DIM_BLOCK), dims]
    bounded = columns.dtype != object
    rest = {c: np.sqrt((columns[c:].astype(np.float64) ** 2).sum(axis=0)) for c in cuts[:-1]} if bounded else {}
    first = queries[:, : cuts[0]] @ columns[: cuts[0]]
    for q in range(len(queries)):
        floor, partial, begin = max(int(scores[q, k - 1]), int(floors[q])), first[q], cuts[0]
        index = np.flatnonzero(rows != query_rows[q])
        if len(index) < len(ids):
            partial = partial[index]
        for cut in cuts[1:]:
            if floor > EMPTY and bounded:
                norm = np.sqrt((queries[q, begin:].astype(np.float64) ** 2).sum())
                more = rest[begin][index] * norm
                # A tie may still win by its id; the slack covers rounding.
                alive = partial + more + (np.abs(partial) + more) * 1e-12 + 1 >= floor
                index, partial = index[alive], partial[alive]
            if not len(index):
                break
            partial = partial + queries[q, begin:cut] @ columns[begin:cut, index]
            begin = cut
        if not bounded:
            partial = np.clip(partial, LOWEST, HIGHEST)
        partial = partial.astype(np.int64)
        alive = partial >= floor
        s = np.concatenate([scores[q], partial[alive]])
        o = np.concatenate([owners[q], ids[index[alive]]])
        order = np.lexsort((o, ~s))[:k]
        scores[q], owners[q] = s[order], o[order]


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """row (a number of its own), vec_id and v, floor(scale * x) of each component as a whole double; vectors that are or hold null or are not finite go."""
    clean = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    # At scales of a power of two the product is exact; what it makes infinite stays the largest number.
    v = F.expr(f"transform(embedding, x -> greatest(-1.7976931348623157E308D, least(1.7976931348623157E308D, {scale} * cast(x AS double))))")
    v = F.transform(v, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return clean.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(column[0]))


def wave_tops(candidates: DataFrame, groups: dict, floors: dict, k: int) -> tuple[DataFrame, object]:
    """row, query_id, vec_id, score: each task's best ``k`` for the queries of a wave, none below the query's floor.

    ``groups``: (rows, vec_ids, matrix) of the queries by length of vector; ``floors``: their scores
    to reach. Also gives the broadcast, to be destroyed when the rows have been written.
    """
    sent = candidates.sparkSession.sparkContext.broadcast((groups, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, floors = sent.value
        tops = {w: (np.full((len(r), k), EMPTY), np.zeros((len(r), k), np.int64)) for w, (r, _, _) in groups.items()}

        def search(found: pa.Table) -> None:
            vectors = found["v"].combine_chunks()
            lengths = np.diff(vectors.offsets.to_numpy())
            for width in np.unique(lengths).tolist():
                if width not in tops:
                    continue
                same = pa.array(lengths == width)
                columns = np.ascontiguousarray(matrix(vectors.filter(same)).T)
                rows, ids = (found[c].filter(same).to_numpy() for c in ("row", "vec_id"))
                query_rows, _, m = groups[width]
                scores, owners = tops[width]
                for a in range(0, len(query_rows), QUERY_BLOCK):
                    b = a + QUERY_BLOCK
                    top_block(m[a:b], query_rows[a:b], columns, rows, ids, floors[width][a:b], scores[a:b], owners[a:b])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= CANDIDATE_BLOCK:
                search(pa.Table.from_batches(held))
                held = []
        if held:
            search(pa.Table.from_batches(held))
        for width, (scores, owners) in tops.items():
            q, place = np.nonzero(scores != EMPTY)
            columns = (groups[width][0][q], groups[width][1][q], owners[q, place], scores[q, place])
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["row", "query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "row long, query_id long, vec_id long, score long"), sent


def exact_top_k(vectors: DataFrame, query_rule: str = "vec_id % 100 = 0", k: int = 10, scale: int = 1024, wave_bytes: int = WAVE_BYTES, seed_rows: int = SEED_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest integer inner products of each query.

    Vectors are turned into whole numbers floor(scale * x). Queries are the rows that ``query_rule``
    selects; every other row is a candidate, ties go to the smaller vec_id, and a query with fewer
    than ``k`` others gets all. Queries go out in waves of about ``wave_bytes``, one after the other:
    a wave is sent to all tasks, each reads its candidates in column blocks and keeps k per query,
    the lists meet by query, the result is written and the wave is taken back, so neither the driver
    nor a task holds more than one wave. Where there are many candidates, ``seed_rows`` of them are
    searched first and give each query a floor; the others need only reach it, and nothing is lost.
    Vectors of different lengths are only compared within their length; rows that share a vec_id are
    rows of their own, as queries and as candidates. Sums are exact at any size of component; a
    score beyond the range of a long counts as its end. Null vectors or ids and vectors that hold
    nulls or non-finite numbers take no part. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, CANDIDATE_BLOCK)
    whole = materialise(whole_vectors(vectors, scale), "vectors")
    queries = whole.where(query_rule)
    n_queries, width = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    per_wave = max(1, wave_bytes // (8 * (width or 1)))
    waves = -(-n_queries // per_wave)
    if not waves:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = -(-whole.count() // seed_rows)
    marked = queries.withColumn("wave", F.pmod(F.xxhash64("row"), F.lit(waves)))
    seeds = whole.where(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)) == 0)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    out = fresh_path(spark, "tops")
    for number in range(waves):
        rows = marked.where(F.col("wave") == number).orderBy("vec_id", "row").select("row", "vec_id", "v").toArrow()
        lengths = np.array([len(v) for v in rows["v"]], np.int64)
        groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        floors: dict[int, np.ndarray] = {}
        for size in np.unique(lengths).tolist():
            part = rows.filter(pa.array(lengths == size))
            groups[size] = (part["row"].to_numpy(), part["vec_id"].to_numpy(), matrix(part["v"].combine_chunks()))
            floors[size] = np.full(part.num_rows, EMPTY)
        if not groups:  # a small table may leave a wave empty
            continue
        if parts > 1:
            tops, sent = wave_tops(seeds, groups, floors, k)
            found = tops.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("row", "score").toPandas()
            at = dict(zip(found["row"].tolist(), found["score"].tolist()))
            floors = {size: np.array([at.get(r, EMPTY) for r in group[0].tolist()], np.int64) for size, group in groups.items()}
            sent.destroy()
        tops, sent = wave_tops(whole, groups, floors, k)
        ranked = tops.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(out)
        sent.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(out)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


TOPK_SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
