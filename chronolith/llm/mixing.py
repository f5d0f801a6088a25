"""Op 8: iterative proportional fitting to source, language and topic marginals; DataFrame functions only."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

DIMENSIONS = ("source", "lang", "topic")
KEYS = [f"mix_{d}" for d in DIMENSIONS]
#: Raking stops when no marginal is further than this from its target, as a share of the budget; looked at every so many rounds.
TOLERANCE, ROUNDS_A_LOOK, MAX_ROUNDS = 1e-6, 3, 60
#: Targets where none are given: the measured shares to this power, made to sum to one (1 keeps the mix, 0 evens it out).
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.5}
BUDGET_SHARE = 0.6
TOPICS = 8
#: Up to so many cells, raking runs in one task and the cells are broadcast; above, both are shuffled, documents with a salt.
SMALL_CELLS, SALTS = 200_000, 32
WORD = r"[^\x20\x09-\x0D]+"


def with_mix_columns(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """Adds mix_source, mix_lang, mix_topic and mix_tokens. Tokens: words. Topic: the column named, else a bucket of the first word."""
    text = F.coalesce("text", F.lit(""))
    first = F.lower(F.regexp_extract(text, WORD, 0))
    bucket = F.concat(F.lit("t"), F.conv(F.substring(F.md5(first.cast("binary")), 1, 2), 16, 10).cast("int") % TOPICS)
    return docs.withColumns({
        "mix_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "mix_topic": F.coalesce(F.col(f"`{topic}`").cast("string"), F.lit("")) if topic else bucket,
        "mix_tokens": F.regexp_count(text, F.lit(WORD)).cast("long"),
    })


def capped_scale(rows: DataFrame, by: list[str], wanted: Column, cap: Column, weight: Column) -> DataFrame:
    """Adds ``scale`` to each group ``by``: the sum of least(cap, scale * weight) over the group is ``wanted``.

    In order of cap / weight, a scale at which the rows before one are full and the others open is
    (wanted - caps before) / (weights from here on). The sum is concave in the scale and each of
    these is at most the right one, so the largest is it: exact, with no steps to repeat. Where all
    caps together are less than ``wanted``, the scale fills every row.
    """
    turn = F.when(weight > 0, cap / weight).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*by).orderBy("turn")
    before, from_here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    tried = rows.withColumn("turn", turn).withColumn("scale", F.try_divide(wanted - F.coalesce(F.sum(cap).over(before), F.lit(0.0)), F.sum(weight).over(from_here)))
    return tried.withColumn("scale", F.greatest(F.lit(0.0), F.coalesce(F.max("scale").over(Window.partitionBy(*by)), F.lit(0.0)))).drop("turn")


def target_tokens(cells: DataFrame, dimension: str, given: Mapping[str, float] | None, temper: float, budget: float, total: float) -> DataFrame:
    """mix_<dimension> and want_<dimension>, the tokens each value shall have in expectation; they sum to the budget.

    Values that ``given`` doesn't name share what it leaves in proportion to their tokens. A value
    whose target is more than all it has gives all it has, and the others make up by their targets.
    """
    name = f"mix_{dimension}"
    values = cells.groupBy(name).agg(F.sum("tokens").alias("cap"))
    if given is None:
        share = F.pow(F.col("cap") / total, F.lit(temper))
    else:
        entries = [F.lit(x) for pair in given.items() for x in (pair[0], float(pair[1]))]
        values = values.withColumn("given", F.create_map(*entries)[F.col(name)] if entries else F.lit(None).cast("double"))
        left = max(0.0, 1.0 - sum(given.values()))
        others = values.where("given IS NULL").agg(F.sum("cap")).first()[0] or 1.0
        share = F.coalesce("given", F.col("cap") / others * left)
    values = materialise(values.withColumn("share", share).select(name, "cap", "share"), f"mix-{dimension}")
    scaled = capped_scale(values.withColumn("all", F.lit(0)), ["all"], F.lit(budget), F.col("cap"), F.col("share"))
    return scaled.select(name, F.least(F.col("cap"), F.col("scale") * F.col("share")).alias(f"want_{dimension}"))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temper: Mapping[str, float] = TEMPER, budget_share: float = BUDGET_SHARE, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS, one_task: bool = True) -> tuple[DataFrame, float]:
    """Cells (mix_source, mix_lang, mix_topic, tokens) with expected tokens and probability, and the largest miss of a marginal.

    Each step scales the cells of every value of a dimension so that what they are expected to give,
    no more than they have, meets the value's target. Rounds end when the miss (a share of the
    budget) is within ``tolerance``, or with a warning after ``max_rounds``, as targets that no
    choice of cells can meet together are never met.
    """
    cells = cells.where("tokens > 0").withColumn("tokens", F.col("tokens").cast("double"))
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    budget = budget_share * total
    state = cells.withColumn("raw", F.col("tokens") * budget_share)
    for d in DIMENSIONS:
        wanted = target_tokens(cells, d, (targets or {}).get(d), temper[d], budget, total)
        state = state.join(F.broadcast(wanted) if one_task else wanted, f"mix_{d}")
    state = materialise(state.coalesce(1) if one_task else state, "mix-state")
    got = F.least("tokens", "raw")
    miss, rounds = 1.0, 0
    while total and miss > tolerance and rounds < max_rounds:
        state = state.coalesce(1) if one_task else state
        for _ in range(min(ROUNDS_A_LOOK, max_rounds - rounds)):
            for d in DIMENSIONS:
                scaled = capped_scale(state, [f"mix_{d}"], F.col(f"want_{d}"), F.col("tokens"), F.col("raw"))
                state = scaled.withColumn("raw", F.col("raw") * F.col("scale")).drop("scale")
            rounds += 1
        state = materialise(state, "mix-state")
        misses = [state.groupBy(f"mix_{d}").agg(F.abs(F.sum(got) - F.first(f"want_{d}")).alias("miss")).select("miss") for d in DIMENSIONS]
        miss = misses[0].unionByName(misses[1]).unionByName(misses[2]).agg(F.max("miss")).first()[0] / budget
    if total and miss > tolerance:
        warnings.warn(f"after {rounds} rounds a marginal still misses its target by {miss:.2g} of the budget", stacklevel=2)
    return state.select(*KEYS, "tokens", got.alias("expected"), F.least(F.lit(1.0), F.col("raw") / F.col("tokens")).alias("probability")), miss if total else 0.0


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the document and the seed alone."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), doc_id.cast("string")).cast("binary")), 1, 13), 16, 10)
    return bits.cast("long") / F.lit(float(2**52))


def mix_sources(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    temper: Mapping[str, float] = TEMPER,
    budget_share: float = BUDGET_SHARE,
    topic: str | None = None,
    seed: int = 11,
    small_cells: int = SMALL_CELLS,
) -> DataFrame:
    """``docs`` with mix_source, mix_lang, mix_topic, mix_tokens, probability and sampled (boolean).

    ``targets`` gives the shares of tokens by dimension (source, lang, topic) and value; a dimension
    without targets has tempered shares, and values that are not named share the rest. Token weights
    of the (source, language, topic) cells are raked until their marginals have the targets; a
    document's probability is its cell's expected tokens against those it has. All of it makes up
    ``budget_share`` of all tokens; a value that has less than its target is taken whole and the
    others make up. ``topic`` names a topic column; without one a bucket of the first word stands in.
    The text is read for counting only: nothing but cells is shuffled (above ``small_cells`` cells
    documents are, by cell and salt), and a source with a third of all rows is pre-aggregated in
    each task. Null source, language and topic count as the empty string; null and empty texts have
    no tokens, and probability 1 where their whole cell has none; rows that repeat a doc_id share
    their draw. An empty table gives no rows. Columns of ``docs`` are kept; those of the names above
    are replaced.
    """
    marked = with_mix_columns(docs, topic)
    cells = materialise(marked.groupBy(*KEYS).agg(F.sum("mix_tokens").alias("tokens")), "mix-cells")
    small = cells.count() <= small_cells
    raked, _ = rake(cells, targets, temper, budget_share, one_task=small)
    raked = materialise(raked.select(*KEYS, "probability"), "mix-weights")
    marked = marked.drop("probability")
    if small:
        joined = marked.join(F.broadcast(raked), KEYS, "left")
    else:
        salted = marked.withColumn("mix_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = salted.join(raked.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*KEYS, "mix_salt"], "left").drop("mix_salt")
    drawn = joined.withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return drawn.withColumn("sampled", uniform(F.col("doc_id"), seed) < F.col("probability"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    mixed = mix_sources(docs)
    return mixed.select(
        "doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("n_tokens"), (F.floor(F.col("probability") * 1e6 + 0.5) / 1e6).alias("probability"), "sampled",
    )


def mixing_sql() -> str:
    """The same query for DuckDB: the rounds are a recursion over all cells at once."""
    steps = [
        f"""docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
        't' || (('0x' || substr(md5(lower(regexp_extract(coalesce(text, ''), '[^ \\x09-\\x0D]+'))), 1, 2))::INT % {TOPICS}) AS topic,
        len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+')) AS n_tokens FROM documents)""",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0)",
        f"whole AS (SELECT sum(tokens) AS total, {BUDGET_SHARE} * sum(tokens) AS budget FROM cells)",
    ]
    for d in DIMENSIONS:
        steps += [
            f"v_{d} AS (SELECT {d}, sum(tokens) AS cap, power(sum(tokens) / any_value(total), {TEMPER[d]}) AS share, any_value(budget) AS budget FROM cells, whole GROUP BY {d})",
            f"s_{d} AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / share, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(share) OVER (ORDER BY cap / share, {d} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM v_{d})",
            f"t_{d} AS (SELECT {d}, least(cap, share * max(scale) OVER ()) AS want_{d} FROM s_{d})",
        ]
    inner = f"(SELECT * FROM raked WHERE i < {MAX_ROUNDS} AND NOT (i % {ROUNDS_A_LOOK} = 0 AND miss <= {TOLERANCE}))"
    columns = "source, lang, topic, tokens, want_source, want_lang, want_topic, budget, i"
    for d in DIMENSIONS:
        inner = f"""(SELECT {columns}, raw * max(scale) OVER (PARTITION BY {d}) AS raw FROM (SELECT *,
          (want_{d} - coalesce(sum(tokens) OVER (PARTITION BY {d} ORDER BY tokens / raw, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(raw) OVER (PARTITION BY {d} ORDER BY tokens / raw, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM {inner} x_{d}) y_{d})"""
    misses = ", ".join(f"abs(sum(least(tokens, raw)) OVER (PARTITION BY {d}) - want_{d})" for d in DIMENSIONS)
    steps += [
        f"""raked AS (SELECT {columns.removesuffix(', i')}, 0 AS i, {BUDGET_SHARE} * tokens AS raw, 1.0::DOUBLE AS miss FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic), whole
        UNION ALL SELECT {columns.removesuffix(', i')}, i + 1, raw, max(miss) OVER () FROM (SELECT *, greatest({misses}) / budget AS miss FROM {inner} z) m)""",
        "final AS (SELECT source, lang, topic, least(1.0, raw / tokens) AS p FROM raked WHERE i = (SELECT max(i) FROM raked))",
    ]
    return "WITH RECURSIVE " + ",\n".join(steps) + f"""
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, floor(p * 1e6 + 0.5) / 1e6 AS probability,
  (('0x' || substr(md5('11/' || d.doc_id), 1, 13))::BIGINT / {float(2**52)}::DOUBLE) < p AS sampled
FROM (SELECT docs.*, coalesce(f.p, 1.0) AS p FROM docs LEFT JOIN final f USING (source, lang, topic)) d"""
