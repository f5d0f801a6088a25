"""Builders of links: discussions to commits, reverts, trackers, and symbol lineage within a commit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.stored import settled
from . import search

# How sure each reading is.
CLOSING_CONFIDENCE, RENAMED, MOVED = 0.9, 0.9, 0.6


def commit_references(commits: DataFrame, issues: DataFrame, owner: str, name: str) -> DataFrame:
    """(commit_id, number, relation, level, confidence): what commit messages say about own issues.

    A closing keyword resolves the issue unless the commit is a revert or was reverted; every other
    mention of a known number is a reference. A number that is mentioned twice is one link.
    """
    message = F.concat_ws("\n", "subject", "body")
    said = commits.select("id", F.explode(text.reference_rows(message, owner, name)).alias("r")).where("r.repo IS NULL").groupBy("id", F.col("r.number").alias("number")).agg(F.bool_or("r.closing").alias("closing"))
    reverts = commits.where(message.rlike(text.REVERT)).select("id")
    undone = search.reverted_commits(commits).select(F.col("target").alias("id"))
    off = reverts.unionByName(undone).distinct().withColumn("off", F.lit(True))
    known = issues.select("number").distinct()
    rows = said.join(known, "number").join(off, "id", "left")
    resolves = F.col("closing") & F.col("off").isNull()
    return rows.select(
        F.col("id").alias("commit_id"), "number", F.when(resolves, "RESOLVED_BY").otherwise("REFERENCES").alias("relation"),
        F.lit("DERIVED").alias("level"), F.when(resolves, CLOSING_CONFIDENCE).otherwise(1.0).alias("confidence"),
    )


def foreign_references(commits: DataFrame, looked_up: DataFrame, owner: str, name: str, limit: int = 50) -> DataFrame:
    """(repo, number) of other repositories' issues that are named and weren't looked up lately; a batch of ``limit``."""
    message = F.concat_ws("\n", "subject", "body")
    named = commits.select(F.explode(text.reference_rows(message, owner, name)).alias("r")).select("r.repo", "r.number").where("repo IS NOT NULL").distinct()
    return named.join(looked_up, ["repo", "number"], "left_anti").orderBy("repo", "number").limit(limit)


def tracker_links(commits: DataFrame, issues: DataFrame) -> DataFrame:
    """(commit_id, number) of tracker issues (number) that messages name by key."""
    keys = commits.select(F.col("id").alias("commit_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws("\n", "subject", "body"), F.lit(text.TRACKER_KEY), F.lit(1)))).alias("number"))
    return keys.join(issues.select("number").distinct(), "number").select("commit_id", "number")


def only_partners(own: DataFrame, other: DataFrame, by: list[str], apart: str | None) -> DataFrame:
    """commit_id, symbol_id and partner of each row of ``own`` that fits one row of ``other`` alone.

    Rows fit that share ``by`` and, with ``apart``, differ in it. Candidates are counted and their
    ids summed, with those of the same ``apart`` taken off, so no pairs are made within a group.
    """
    sums = lambda keys, n, s: other.groupBy(*keys).agg(F.count("*").alias(n), F.sum(F.col("symbol_id").cast("decimal(38,0)")).alias(s))
    counted = own.join(sums(by, "n", "s"), by)
    if apart:
        counted = counted.join(sums([*by, apart], "same", "same_s"), [*by, apart], "left").fillna(0, ["same"]).withColumn("same_s", F.coalesce("same_s", F.lit(0)))
        counted = counted.withColumn("n", F.col("n") - F.col("same")).withColumn("s", F.col("s") - F.col("same_s"))
    return counted.where("n = 1").select("commit_id", "symbol_id", F.col("s").cast("long").alias("partner"))


#: (method, level, confidence, columns that agree, column that differs), strongest first.
LINEAGE_RULES = (
    ("moved", "DERIVED", RENAMED, ["commit_id", "kind", "qualified_name", "shape"], "file_id"),
    ("renamed", "DERIVED", RENAMED, ["commit_id", "kind", "file_id", "shape"], None),
    ("moved-with-edits", "INFERRED", MOVED, ["commit_id", "kind", "qualified_name"], "file_id"),
)


def symbol_lineage(born: DataFrame, removed: DataFrame) -> DataFrame:
    """(commit_id, born, removed, method, level, confidence): which removed symbol a new one continues.

    Both sides: commit_id, symbol_id, file_id, kind, qualified_name, shape. First the same name and
    shape in another file (moved unchanged); then, of what is left, the same shape in the same file
    (a rename); at last the same name in another file (moved with edits). Only a match that is the
    one candidate of both sides counts; a null name or shape fits nothing.
    """
    names = ["commit_id", "symbol_id", "file_id", "kind", "qualified_name", "shape"]
    left, right = settled(born.select(*names).distinct()), settled(removed.select(*names).distinct())
    found = []
    for method, level, confidence, by, apart in LINEAGE_RULES:
        there = " AND ".join(f"{c} IS NOT NULL" for c in by)
        mine, theirs = settled(only_partners(left.where(there), right.where(there), by, apart)), settled(only_partners(right.where(there), left.where(there), by, apart))
        both = settled(mine.toDF("commit_id", "born", "removed").join(theirs.toDF("commit_id", "removed", "born"), ["commit_id", "born", "removed"]))
        found.append(both.select("commit_id", "born", "removed", F.lit(method).alias("method"), F.lit(level).alias("level"), F.lit(confidence).alias("confidence")))
        if method != LINEAGE_RULES[-1][0]:
            left = settled(left.join(both.select("commit_id", F.col("born").alias("symbol_id")), ["commit_id", "symbol_id"], "left_anti"))
            right = settled(right.join(both.select("commit_id", F.col("removed").alias("symbol_id")), ["commit_id", "symbol_id"], "left_anti"))
    return reduce(DataFrame.unionByName, found)
