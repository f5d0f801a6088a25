"""Answers from statements, call and target resolution, closures, and the gate for claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import round2, weakest
from ..functions.stored import settled


def conclude(statements: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``by``, answer, confidence, level from statements (text, confidence, level): texts in order, least confidence, weakest level."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("text").alias("t")))), lambda s: s["t"])
    return statements.groupBy(*by).agg(F.array_join(texts, " ").alias("answer"), F.min(F.col("confidence").cast("double")).alias("confidence"), weakest(F.col("level")).alias("level"))


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_id, line, callee, target, rule): the definition a call names, by the first rule that has one alone."""
    named = symbols.select(F.col("file_id").alias("in_file"), F.col("name").alias("callee"), F.col("id").alias("target"))
    own = calls.withColumn("in_file", F.col("file_id")).withColumn("rule", F.lit(1))
    imported = calls.join(imports, F.col("file_id") == F.col("source")).select(*calls.columns, F.col("target").alias("in_file"), F.lit(2).alias("rule"))
    found = own.unionByName(imported).join(named, ["in_file", "callee"])
    site = Window.partitionBy("file_id", "line", "callee")
    ranked = found.withColumn("best", F.min("rule").over(site)).withColumn("n", F.count("*").over(site.partitionBy("file_id", "line", "callee", "rule")))
    return ranked.where("rule = best AND n = 1").select("file_id", "line", "callee", "target", "rule")


def closure(seeds: DataFrame, ties: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Ids that ``ties`` (a, b) connect to the seeds, either way; only what is new moves in a round."""
    both = ties.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")).distinct()
    seen = fresh = seeds.distinct().checkpoint()
    for _ in range(max_rounds):
        fresh = fresh.join(both, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti").checkpoint()
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh).checkpoint()
    return seen


def gate(claims: DataFrame, known: DataFrame, ceiling: float) -> DataFrame:
    """Claims (claim_id, confidence, cited) all of whose citations are known, clamped to the ceiling."""
    each = claims.where(F.size("cited") > 0).select("claim_id", "confidence", F.explode("cited").alias("id"))
    marked = each.join(known.select("id", F.lit(1).alias("ok")), "id", "left")
    sound = marked.groupBy("claim_id", "confidence").agg(F.count("*").alias("n"), F.count("ok").alias("m")).where("n = m")
    return sound.select("claim_id", round2(F.least(F.lit(ceiling), F.col("confidence"))).alias("confidence"))


# What an input may look like.
ISSUE_NUMBER, DEPENDENCY, SHA_PREFIX, FILE_SYMBOL = r"(?i)^(?:#|GH-)(\d+)$", r"^(npm|go|cargo|pypi):(.+)$", r"(?i)^[0-9a-f]{7,64}$", r"^(.+\.[A-Za-z0-9]+):([^/:]+)$"


def resolve_targets(inputs: DataFrame, commits: DataFrame, files: DataFrame, symbols: DataFrame, discussions: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(input, kind, id, how) of all that each input may name, for many inputs at once.

    ``inputs``: input; ``discussions``: type, id, number; ``dependencies``: id, ecosystem, name. #12
    or GH-12 is an issue or pull request, npm:zod a dependency, seven hexadecimal digits or more a
    commit, a path a file (either slash), path:Symbol a symbol of that file, anything else that
    isn't one of these a symbol's name, where the one current definition wins over former ones.
    Every rule that applies contributes; an empty input names nothing.
    """
    given = settled(inputs.select("input", F.trim("input").alias("t")).where("t <> ''").distinct())
    # Kinds and ways differ from rule to rule, so each rule's rows are made distinct apart, and written out before the next.
    kinds = lambda df, kind, how: settled(df.select("input", (kind if not isinstance(kind, str) else F.lit(kind)).alias("kind"), F.col("id"), F.lit(how).alias("how")).distinct())
    t = F.col("t")
    numbered = given.where(t.rlike(ISSUE_NUMBER)).withColumn("number", F.regexp_extract(t, ISSUE_NUMBER, 1).try_cast("long"))
    found = [kinds(numbered.join(discussions.select("type", "id", F.col("number").try_cast("long").alias("number")).distinct(), "number"), F.col("type"), "issue or pull request number")]
    named = given.where(t.rlike(DEPENDENCY)).withColumn("ecosystem", F.regexp_extract(t, DEPENDENCY, 1)).withColumn("name", F.regexp_extract(t, DEPENDENCY, 2))
    found.append(kinds(named.join(dependencies, ["ecosystem", "name"]), "dependency", "dependency"))
    # Prefixes and hashes meet by their first seven digits.
    prefixes = given.where(t.rlike(SHA_PREFIX)).withColumn("head", F.lower(F.substring(t, 1, 7)))
    hashed = commits.select("id", "sha", F.substring("sha", 1, 7).alias("head"))
    found.append(kinds(prefixes.join(hashed, "head").where(F.startswith("sha", F.lower(t))), "commit", "commit sha prefix"))
    slashed = lambda column: F.replace(column, F.lit("\\"), F.lit("/"))
    found.append(kinds(given.withColumn("path", slashed(t)).join(files.select("id", "path"), "path"), "file", "file path"))
    both = settled(symbols.select("id", "file_id", "current", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name")))
    within = given.where(t.rlike(FILE_SYMBOL)).withColumn("path", slashed(F.regexp_extract(t, FILE_SYMBOL, 1))).withColumn("name", F.regexp_extract(t, FILE_SYMBOL, 2))
    found.append(kinds(within.join(files.select(F.col("id").alias("file_id"), "path"), "path").join(both, ["file_id", "name"]), "symbol", "symbol in file"))
    free = given.where(~t.rlike(FILE_SYMBOL) & ~t.rlike(ISSUE_NUMBER) & ~t.rlike(DEPENDENCY)).withColumnRenamed("t", "name")
    current = both.where("current").groupBy("name").agg(F.count("*").alias("n"))
    matched = free.join(both, "name").join(current, "name", "left")
    found.append(kinds(matched.where("current OR n IS NULL OR n <> 1"), "symbol", "symbol name"))
    return reduce(DataFrame.unionByName, found)


#: Days for which a lookup that found nothing isn't made again.
LOOKUP_DAYS = 7


def due_lookups(wanted: DataFrame, checked: DataFrame, now: DataFrame, by: list[str], days: int = LOOKUP_DAYS) -> DataFrame:
    """``wanted`` keys that are to be looked up, with reason: 'new' (never looked up) or 'expired' (``days`` ago or longer).

    ``checked``: keys and checked_at of lookups that found nothing; ``now``: one row, now.
    """
    last = checked.groupBy(*by).agg(F.max("checked_at").alias("last"))
    rows = wanted.join(last, by, "left").crossJoin(F.broadcast(now))
    due = rows.where(F.col("last").isNull() | (F.col("last") <= F.col("now") - F.make_dt_interval(F.lit(days))))
    return due.select(*by, F.when(F.col("last").isNull(), "new").otherwise("expired").alias("reason"))
