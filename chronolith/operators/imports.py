"""Import resolution as joins: candidate paths in order, unique suffixes, longest prefixes.

Each resolver takes import rows (import_id, path of the importing file, specifier) and gives
(import_id, target, confidence, method) for those it can place; what stays ambiguous gets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

SUFFIX_CONFIDENCE = 0.9
#: Path patterns of one configuration, at most.
PATTERNS = 10_000
# What a relative specifier may stand for, in order of preference.
EXTENSIONS = ("ts", "tsx", "mts", "cts", "d.ts", "js", "jsx", "mjs", "cjs", "json")


def joined_path(directory: Column, relative: Column) -> Column:
    """The path that ``relative`` names from ``directory``; null if it leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(directory, F.lit("")), relative), "/"), lambda p: (p != "") & (p != "."))

    def step(state: Column, part: Column) -> Column:
        up = part == ".."
        return F.struct(
            F.when(up, F.slice(state["s"], F.lit(1), F.greatest(F.size(state["s"]) - 1, F.lit(0)))).otherwise(F.concat(state["s"], F.array(part))).alias("s"),
            (state["bad"] | (up & (F.size(state["s"]) == 0))).alias("bad"),
        )

    start = F.struct(F.array().cast("array<string>").alias("s"), F.lit(False).alias("bad"))
    return F.aggregate(parts, start, step, lambda state: F.when(~state["bad"], F.array_join(state["s"], "/")))


def relative_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``./x`` and ``../x``: the path itself, with an extension, or its index file; the first that exists."""
    base = joined_path(paths.directory(F.col("path")), F.col("specifier"))
    rows = imports.where(F.col("specifier").rlike(r"^\.\.?(/|$)")).withColumn("base", base).where("base IS NOT NULL")
    # A .js specifier may stand for the TypeScript source it is made from.
    bare = F.regexp_replace("base", r"\.(js|jsx|mjs|cjs)$", "")
    source = [F.when(bare != F.col("base"), F.concat(bare, F.lit(f".{e}"))) for e in ("ts", "tsx", "mts", "cts")]
    tried = F.array(F.col("base"), *source, *[F.concat("base", F.lit(f".{e}")) for e in EXTENSIONS], *[F.concat("base", F.lit(f"/index.{e}")) for e in EXTENSIONS])
    tried = rows.select("import_id", F.posexplode(tried).alias("place", "candidate")).where("candidate IS NOT NULL")
    found = tried.join(files.select(F.col("path").alias("candidate")), "candidate")
    best = found.groupBy("import_id").agg(F.min_by("candidate", "place").alias("target"))
    return best.select("import_id", "target", F.lit(1.0).alias("confidence"), F.lit("relative-path").alias("method"))


def python_modules(files: DataFrame) -> DataFrame:
    """(module, target, confidence): each dotted name from the root, and each ending that one file alone has."""
    parts = F.split(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "(^|/)__init__$", ""), "/")
    rows = files.where(F.col("path").endswith(".py")).select("path", parts.alias("parts")).where("parts[0] <> ''")
    endings = rows.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.array_join(F.slice(F.col("parts"), i + 1, F.size("parts")), "."))).alias("cut", "module"))
    exact = endings.where("cut = 0").groupBy("module").agg(F.min("path").alias("target")).withColumn("confidence", F.lit(1.0))
    inferred = endings.groupBy("module").agg(F.count("*").alias("n"), F.min("path").alias("target")).where("n = 1").select("module", "target", F.lit(SUFFIX_CONFIDENCE).alias("confidence"))
    return exact.unionByName(inferred.join(exact, "module", "left_anti"))


def python_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Absolute module names, from the root or by a unique ending."""
    rows = imports.where(~F.col("specifier").startswith(".")).select("import_id", F.col("specifier").alias("module"))
    return rows.join(python_modules(files), "module").select("import_id", "target", "confidence", F.when(F.col("confidence") == 1, "module-path").otherwise("module-suffix").alias("method"))


def longest_prefix(imports: DataFrame, known: DataFrame) -> DataFrame:
    """(import_id, name): the longest of ``known`` (name) that the specifier is or begins with, at a slash.

    Each specifier is cut at its slashes, so this is an equality join and not a prefix scan.
    """
    parts = F.split("specifier", "/")
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    tried = imports.select("import_id", F.posexplode(cuts).alias("place", "name"))
    return tried.join(known.select("name").distinct(), "name").groupBy("import_id").agg(F.max_by("name", "place").alias("name"))


def alias_targets(imports: DataFrame, patterns: DataFrame) -> DataFrame:
    """(import_id, target): specifiers through path patterns (pattern, replacement) with one wildcard each.

    An exact pattern wins over wildcards, and the longest prefix wins among those. ``patterns`` is one
    configuration; more than PATTERNS of them are refused, as all are held against each specifier.
    """
    if patterns.count() > PATTERNS:
        raise ValueError(f"more than {PATTERNS} path patterns")
    split = patterns.select("pattern", "replacement", F.substring_index("pattern", "*", 1).alias("head"), F.when(F.col("pattern").contains("*"), F.substring_index("pattern", "*", -1)).alias("tail"))
    hit = F.when(F.col("tail").isNull(), F.col("specifier") == F.col("pattern")).otherwise(
        F.startswith("specifier", "head") & F.endswith("specifier", "tail") & (F.length("specifier") >= F.length("head") + F.length("tail"))
    )
    rows = imports.join(F.broadcast(split), hit)
    star = F.expr("substring(specifier, length(head) + 1, length(specifier) - length(head) - length(coalesce(tail, '')))")
    rank = F.struct(F.col("tail").isNull(), F.length("head"), F.col("pattern"))
    rows = rows.withColumn("target", F.when(F.col("tail").isNull(), F.col("replacement")).otherwise(F.replace("replacement", F.lit("*"), star)))
    return rows.groupBy("import_id").agg(F.max_by("target", rank).alias("target"))
