"""Call edges: each call site read by the first rule that may apply, ambiguity kept as no answer.

The first name of the callee decides: the caller's own object (its class), a local variable (only
a unique qualified name), a name that an import binds (the imported definition or nothing), else a
definition of the file, else a unique qualified name anywhere. A stated type makes a reading less
sure, passing a function by name a likely call; what a type checker resolved replaces all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stored import settled
from . import search

# How sure each reading is.
BINDING, QUALIFIED, STATED_TYPE, PASSED = 0.95, 0.6, 0.9, 0.8
# What a function passed by name can be.
FUNCTION_KINDS = ("function", "method")


def alone(symbols: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and target where one symbol alone has it."""
    return symbols.groupBy(*by).agg(F.count("*").alias("n"), F.min("id").alias("target")).where("n = 1").drop("n")


def read_sites(sites: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """(site, target, level, confidence, method) of the sites that a rule resolves.

    ``sites``: site, file_id, caller_id (null: module level), callee, self_receiver, local_head;
    ``symbols``: id, file_id, qualified_name of current symbols; ``bindings``: file_id, local_name,
    imported, confidence, targets (array of file ids; empty for what is outside the repository).
    """
    path = F.split("callee", r"\.")
    rows = sites.withColumn("n", F.size(path)).withColumn("head", path[0]).withColumn("name", F.element_at(path, -1)).withColumn("rest", F.array_join(F.slice(path, F.lit(2), F.size(path)), "."))
    rows = rows.where(~F.col("name").isin("", "*") & (F.col("head") != "*"))
    in_file, anywhere = settled(alone(symbols, ["file_id", "qualified_name"])), settled(alone(symbols, ["qualified_name"]))
    # Each reading is written out, so that its shuffles leave the disk before the next.
    given = lambda df, level, confidence, method: settled(df.select("site", "target", F.lit(level).alias("level"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"), F.lit(method).alias("method")))

    own = rows.where("self_receiver AND n = 2").join(symbols.select(F.col("id").alias("caller_id"), F.col("qualified_name").alias("caller_name")), "caller_id").where(F.col("caller_name").contains("."))
    own = own.withColumn("qualified_name", F.concat(F.regexp_replace("caller_name", r"\.[^.]*$", ""), F.lit("."), "name"))
    parts = [given(own.join(in_file, ["file_id", "qualified_name"]), "DERIVED", 1.0, "same-class")]

    others = rows.where("NOT self_receiver")
    named = bindings.select("file_id", F.col("local_name").alias("head"), "imported", "targets", F.col("confidence").alias("sure"))
    met = settled(others.where("NOT local_head").join(named, ["file_id", "head"], "left"))
    bound = met.where("imported IS NOT NULL")
    whole, only_named = F.col("imported") == "*", ~F.col("imported").isin("*", "default")
    member = F.when((F.col("n") == 1) & only_named, F.col("imported")).when((F.col("n") >= 2) & whole, F.col("rest")).when((F.col("n") >= 2) & only_named, F.concat_ws(".", "imported", "rest"))
    reached = bound.select("site", "sure", member.alias("qualified_name"), F.explode("targets").alias("file_id")).join(symbols.select("file_id", "qualified_name", "id"), ["file_id", "qualified_name"])
    reached = reached.groupBy("site", "sure").agg(F.count("*").alias("found"), F.min("id").alias("target")).where("found = 1")
    parts.append(given(reached, "DERIVED", F.least(F.lit(BINDING), F.col("sure")), "import-binding"))

    free = met.where("imported IS NULL").withColumn("qualified_name", F.col("callee")).join(in_file, ["file_id", "qualified_name"], "left")
    free = settled(free.select("site", "qualified_name", "n", "target"))
    parts.append(given(free.where("target IS NOT NULL"), "DERIVED", 1.0, "same-file"))
    far = free.where("target IS NULL AND n >= 2").select("site", "qualified_name").unionByName(others.where("local_head AND n >= 2").select("site", F.col("callee").alias("qualified_name")))
    parts.append(given(far.join(anywhere, "qualified_name"), "INFERRED", QUALIFIED, "qualified-name"))
    return reduce(DataFrame.unionByName, parts)


def call_edges(calls: DataFrame, symbols: DataFrame, bindings: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """(source_type, source_id, target, level, confidence, method, line, callee): one edge from each caller to each definition.

    ``calls``: file_id, line, callee, self_receiver, local_head, via ('call' or 'reference'), written
    (the name a stated type replaced, or null); ``symbols``: id, file_id, name, qualified_name,
    kind, start_line, end_line of current symbols; ``checked``: from_file, line, to_file, to_line,
    to_name. The caller is the innermost symbol around the line, else the file. Of several sites the
    surest is cited, then the first by line and callee; a symbol doesn't call itself.
    """
    symbols = settled(symbols.select("id", "file_id", "name", "qualified_name", "kind", "start_line", "end_line"))
    calls = settled(calls.withColumn("site", F.struct("file_id", "line", "callee")))
    if checked is not None:
        calls = calls.join(checked.select(F.col("from_file").alias("file_id"), "line").distinct(), ["file_id", "line"], "left_anti")
    around = search.innermost(calls.select("file_id", "line", "callee"), symbols)
    sites = settled(calls.join(around, ["file_id", "line", "callee"], "left"))
    found = settled(read_sites(sites, symbols, bindings).join(symbols.select(F.col("id").alias("target"), "kind"), "target"))
    told = sites.select("site", "file_id", "line", "callee", "caller_id", "via", "written").join(found, "site")
    passed, typed = F.col("via") == "reference", F.col("written").isNotNull()
    told = told.where(~passed | F.col("kind").isin(*FUNCTION_KINDS))
    sure = F.when(typed, F.col("confidence") * STATED_TYPE).otherwise(F.col("confidence"))
    method = F.concat("method", F.when(typed, "+stated-type").otherwise(""), F.when(passed, "+passed-as-value").otherwise(""))
    read = settled(told.select("file_id", "line", "callee", "caller_id", "target", F.when(passed, "INFERRED").otherwise(F.col("level")).alias("level"), F.when(passed, F.least(sure, F.lit(PASSED))).otherwise(sure).alias("confidence"), method.alias("method")))
    if checked is not None:
        spots = settled(checked.select(F.col("from_file").alias("file_id"), "line", "to_file", "to_line", "to_name").distinct())
        aims = spots.select(F.col("to_file").alias("file_id"), F.col("to_line").alias("line"), F.col("to_name").alias("callee")).distinct()
        # Only definitions of the name are looked at, so a bin holds those alone.
        hit = search.innermost(aims, symbols.join(aims.select("file_id", F.col("callee").alias("name")).distinct(), ["file_id", "name"], "left_semi"), named=True)
        hit = settled(hit.select(F.col("file_id").alias("to_file"), F.col("line").alias("to_line"), F.col("callee").alias("to_name"), F.col("caller_id").alias("target")))
        from_ = settled(search.innermost(spots.select("file_id", "line", F.lit("").alias("callee")).distinct(), symbols).drop("callee"))
        exact = spots.join(hit, ["to_file", "to_line", "to_name"]).join(from_, ["file_id", "line"], "left")
        read = read.unionByName(exact.select("file_id", "line", F.col("to_name").alias("callee"), "caller_id", "target", F.lit("DERIVED").alias("level"), F.lit(1.0).alias("confidence"), F.lit("typescript-checker").alias("method")))
    read = read.where("caller_id IS NULL OR caller_id <> target")
    source = [F.when(F.col("caller_id").isNull(), "file").otherwise("symbol").alias("source_type"), F.coalesce("caller_id", "file_id").alias("source_id")]
    exact_first = F.col("method") == "typescript-checker"
    best = F.min_by(F.struct("level", "confidence", "method", "line", "callee"), F.struct(~exact_first, -F.col("confidence"), "file_id", "line", "callee"))
    return read.select("*", *source).groupBy("source_type", "source_id", "target").agg(best.alias("b")).select("source_type", "source_id", "target", "b.*")
