"""Evidence levels and confidences.

FACT (observed), DERIVED (deterministic), INFERRED (heuristic). Combining takes the weakest level;
along a chain confidences multiply, over statements and copy links the smallest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("FACT", "DERIVED", "INFERRED")


def level_rank(level: Column) -> Column:
    return F.when(level == "INFERRED", 2).when(level == "DERIVED", 1).when(level == "FACT", 0)


def level_name(rank: Column) -> Column:
    """Name of a rank; null (nothing to combine) is FACT."""
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce(rank, F.lit(0)) + 1)


def weakest(level: Column) -> Column:
    """Aggregate: the weakest level of a group, FACT for an empty one."""
    return level_name(F.max(level_rank(level)))


def chain_confidence(values: Column) -> Column:
    """Product of an array of confidences."""
    return F.aggregate(values, F.lit(1.0), lambda acc, x: acc * x)


def round3(x: Column) -> Column:
    """Three decimals, halves up."""
    return F.floor(x * 1000 + 0.5) / 1000


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def invalid_relations(relations: DataFrame) -> DataFrame:
    """Rows that break a rule, with ``problem``: confidence outside [0, 1], a FACT that isn't sure, an INFERRED link without evidence."""
    problem = (
        F.when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), "confidence outside [0, 1]")
        .when((F.col("level") == "FACT") & (F.col("confidence") != 1), "fact with confidence below 1")
        .when((F.col("level") == "INFERRED") & (F.size(F.coalesce("evidence_ids", F.array().cast("array<bigint>"))) == 0), "inferred without evidence")
        .when(~F.col("level").isin(*LEVELS), "unknown level")
    )
    return relations.withColumn("problem", problem).where("problem IS NOT NULL")
