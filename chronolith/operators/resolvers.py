"""What an import names, by the rules of Rust and of ECMAScript with its configuration files, as joins.

Each resolver takes import rows and gives one row an import: import_id, kind (files, builtin,
dependency or unresolved), target (a path or a package), method, and reason where nothing is found.
Rules are tried in order; a rule that applies and finds nothing says so and guesses nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .imports import joined_path

# Crates that come with the compiler.
RUST_BUILTIN = ("std", "core", "alloc", "proc_macro", "test")
# Files whose child modules lie next to them.
RUST_ROOTS = ("mod", "lib", "main")
# What a module path may end in, in order, and the sources of an output file.
ES_EXTENSIONS = (".ts", ".tsx", ".d.ts", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
ES_SOURCES = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}
# Modules of the runtime, by the first part of their name.
NODE_BUILTIN = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2",
    "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls",
    "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)


def child_path(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat_ws("/", directory, name))


def nearest(rows: DataFrame, dirs: DataFrame, by: list[str]) -> DataFrame:
    """``by`` (which holds path) with the columns of ``dirs`` (dir, ...) for the nearest directory at or above the file's."""
    others = [c for c in dirs.columns if c != "dir"]
    above = rows.select(*by).distinct().select(*by, F.posexplode(paths.ancestors(F.col("path"))).alias("steps", "dir"))
    return above.join(dirs, "dir").groupBy(*by).agg(F.min_by(F.struct("dir", *others), "steps").alias("near")).select(*by, "near.*")


# Rust


def rust_modules(files: DataFrame) -> DataFrame:
    """(dir, name, file, child): the file of each module by its parent's directory; ``name.rs`` before ``name/mod.rs``."""
    rows = files.where(F.col("path").endswith(".rs")).select(F.col("path").alias("file"), paths.directory(F.col("path")).alias("at"), F.regexp_extract("path", r"([^/]+)\.rs$", 1).alias("stem"))
    child = F.when(F.col("stem").isin(*RUST_ROOTS), F.col("at")).otherwise(child_path(F.col("at"), F.col("stem")))
    plain = rows.select(F.col("at").alias("dir"), F.col("stem").alias("name"), "file", child.alias("child"), F.lit(0).alias("place"))
    nested = rows.where("stem = 'mod' AND at <> ''").select(paths.directory(F.col("at")).alias("dir"), F.regexp_extract("at", "([^/]+)$", 1).alias("name"), "file", F.col("at").alias("child"), F.lit(1).alias("place"))
    return plain.unionByName(nested).groupBy("dir", "name").agg(F.min_by(F.struct("file", "child"), "place").alias("m")).select("dir", "name", "m.*")


def walk_modules(starts: DataFrame, modules: DataFrame) -> DataFrame:
    """(import_id, file, depth): the deepest module that the segments lead to from a crate's root.

    ``starts``: import_id, segments, dir, file. The module table is a trie: a round takes one
    segment of all paths that still go on, so rounds are the longest path's segments.
    """
    frontier = starts.select("import_id", "segments", "dir", "file", F.lit(0).alias("depth"))
    ended: list[DataFrame] = []
    while True:
        open_ = frontier.where(F.size("segments") > F.col("depth")).withColumn("name", F.expr("segments[depth]"))
        step = open_.join(modules.select("dir", "name", F.col("file").alias("to"), "child"), ["dir", "name"], "left").checkpoint()
        ended.append(frontier.where(F.size("segments") <= F.col("depth")).select("import_id", "file", "depth"))
        ended.append(step.where("to IS NULL").select("import_id", "file", "depth"))
        frontier = step.where("to IS NOT NULL").select("import_id", "segments", F.col("child").alias("dir"), F.col("to").alias("file"), (F.col("depth") + 1).alias("depth"))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, ended)


def rust_imports(imports: DataFrame, files: DataFrame, crates: DataFrame) -> DataFrame:
    """``imports``: import_id, path, form ('mod' or 'use'), specifier; ``crates``: path of each Cargo.toml, dependencies (array of names)."""
    modules = rust_modules(files).checkpoint()
    cargo = crates.select(paths.directory(F.col("path")).alias("dir"), F.col("path").alias("manifest"), "dependencies")
    result = lambda rows, kind, target, method, reason: rows.select("import_id", kind.alias("kind"), target.alias("target"), method.alias("method"), reason.alias("reason"))
    none = F.lit(None).cast("string")
    found_or = lambda target, miss: (F.when(target.isNotNull(), "files").otherwise("unresolved"), F.when(target.isNull(), miss))

    stem = F.regexp_extract("path", r"([^/]+)\.rs$", 1)
    at = paths.directory(F.col("path"))
    declared = imports.where("form = 'mod'").select("import_id", F.col("specifier").alias("name"), F.when(stem.isin(*RUST_ROOTS), at).otherwise(child_path(at, stem)).alias("dir"))
    declared = declared.join(modules, ["dir", "name"], "left")
    kind, reason = found_or(F.col("file"), F.concat(F.lit("no file for module "), "name"))
    parts = [result(declared, kind, F.col("file"), F.when(F.col("file").isNotNull(), "rust-mod-declaration"), reason)]

    uses = imports.where("form = 'use'").withColumn("parts", F.split("specifier", "::")).withColumn("first", F.expr("parts[0]"))
    relative = uses.where("first IN ('crate', 'self', 'super')")
    known = files.select(F.col("path").alias("root"))
    candidates = cargo.select("dir", F.posexplode(F.array(child_path(F.col("dir"), F.lit("src/lib.rs")), child_path(F.col("dir"), F.lit("src/main.rs")))).alias("place", "root"))
    roots = candidates.join(known, "root").groupBy("dir").agg(F.min_by("root", "place").alias("root"))
    unit = nearest(relative, cargo.select("dir"), ["path"]).join(roots, "dir", "left").drop("dir")
    placed = relative.join(unit, "path", "left").withColumn("src", paths.directory(F.col("root")))
    inside = F.expr("substring(path, length(src) + 2)")
    own = F.split(F.regexp_replace(inside, r"\.rs$", ""), "/")
    own = F.when(F.col("path") == F.col("root"), F.array().cast("array<string>")).when(F.startswith("path", F.concat("src", F.lit("/"))) & F.col("path").endswith(".rs") & (own[0] != "bin"), F.when(F.element_at(own, -1) == "mod", F.slice(own, F.lit(1), F.size(own) - 1)).otherwise(own))
    lead = F.regexp_extract("specifier", "^((?:super(?:::|$))*)", 1)
    placed = placed.withColumn("own", own).withColumn("ups", (F.regexp_count(lead, F.lit("super"))).cast("int"))
    base = F.when(F.col("first") == "crate", F.array().cast("array<string>")).when(F.col("first") == "self", F.col("own")).when(F.col("ups") <= F.size("own"), F.slice("own", F.lit(1), F.size("own") - F.col("ups")))
    rest = F.when(F.col("first") == "super", F.slice("parts", F.col("ups") + 1, F.size("parts"))).otherwise(F.slice("parts", F.lit(2), F.size("parts")))
    problem = F.when(F.col("root").isNull(), "no crate root (src/lib.rs or src/main.rs) found").when(F.col("own").isNull(), "file is not part of the crate module tree").when(F.col("base").isNull(), "super:: goes above the crate root")
    placed = placed.withColumn("base", base).withColumn("rest", rest).withColumn("problem", problem).checkpoint()
    walked = walk_modules(placed.where("problem IS NULL").select("import_id", F.concat("base", "rest").alias("segments"), F.col("src").alias("dir"), F.col("root").alias("file")), modules)
    ended = placed.join(walked, "import_id", "left").withColumn("target", F.when(F.col("depth") >= F.size("base"), F.col("file")))
    kind, reason = found_or(F.col("target"), F.coalesce("problem", F.concat(F.lit("no module file for "), "specifier")))
    parts.append(result(ended, kind, F.col("target"), F.when(F.col("target").isNotNull(), F.concat(F.lit("rust-"), "first", F.lit("-path"))), reason))

    parts.append(result(uses.where(F.col("first").isin(*RUST_BUILTIN)), F.lit("builtin"), none, none, none))
    outside = uses.where(~F.col("first").isin("crate", "self", "super", *RUST_BUILTIN))
    # Crate names have - in the manifest and _ in code.
    named = cargo.select("dir", F.explode("dependencies").alias("crate")).withColumn("first", F.regexp_replace("crate", "-", "_"))
    above = outside.select("import_id", "first", F.posexplode(paths.ancestors(F.col("path"))).alias("steps", "dir")).join(named, ["dir", "first"])
    nearest_crate = above.groupBy("import_id").agg(F.min_by("crate", F.struct("steps", "crate")).alias("crate"))
    outside = outside.join(nearest_crate, "import_id", "left")
    there = F.col("crate").isNotNull()
    parts.append(result(outside, F.when(there, "dependency").otherwise("unresolved"), F.col("crate"), F.when(there, "declared-crate"), F.when(~there, F.concat(F.lit("crate "), "first", F.lit(" is not declared in Cargo.toml")))))
    return reduce(DataFrame.unionByName, parts)


# ECMAScript

_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
_COMMA = re.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', re.S)
CONFIG_SCHEMA = "path string, extends array<string>, base_url string, patterns array<struct<pattern string, targets array<string>>>"


def parse_config(content: str) -> tuple[list[str], str | None, list[dict] | None] | None:
    """extends, baseUrl and path patterns of a configuration file; comments and trailing commas may be there. None if it can't be read."""
    text = _COMMA.sub(lambda m: m[1] or "", _COMMENT.sub(lambda m: m[1] or "", content.removeprefix("\ufeff")))
    try:
        data = json.loads(text)
    except ValueError:
        return None
    if not isinstance(data, dict):
        return None
    listed = lambda x: [x] if isinstance(x, str) else [v for v in x if isinstance(v, str)] if isinstance(x, list) else []
    options = data.get("compilerOptions")
    options = options if isinstance(options, dict) else {}
    found = options.get("paths")
    patterns = [{"pattern": k, "targets": [t for t in listed(v) if t.count("*") <= 1]} for k, v in found.items() if k.count("*") <= 1] if isinstance(found, dict) else None
    base = options.get("baseUrl")
    return listed(data.get("extends")), base if isinstance(base, str) else None, patterns


def read_configs(files: DataFrame) -> DataFrame:
    """Configuration rows (columns of CONFIG_SCHEMA) of files (path, content); those that can't be read are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(p, parse_config(c or "")) for p, c in zip(batch["path"], batch["content"])]
            yield pd.DataFrame([(p, *c) for p, c in found if c], columns=["path", "extends", "base_url", "patterns"])

    wanted = files.where(F.regexp_extract("path", "[^/]+$", 0).rlike(r"^[tj]sconfig(\..+)?\.json$") | F.col("path").endswith(".json"))
    return wanted.select("path", "content").mapInPandas(run, CONFIG_SCHEMA)


def effective_configs(configs: DataFrame, files: DataFrame) -> DataFrame:
    """(config, base_in, base_dir, paths_in, paths_dir, patterns): settings of each configuration with what it extends.

    The nearest wins: the file itself, then its last ``extends`` entry with all that one extends, then
    the one before. Ranks are arrays of places, whose order is that of precedence. Only files of the
    repository are followed, and a file isn't entered twice on one way. ``base_dir`` is null where
    baseUrl leaves the repository, ``paths_dir`` where patterns therefore don't apply.
    """
    own = configs.select("path", "extends", "base_url", "patterns").checkpoint()
    written = own.select("path", F.size("extends").alias("n"), F.posexplode("extends").alias("place", "entry")).where(F.col("entry").rlike(r"^\.\.?/"))
    written = written.withColumn("to", joined_path(paths.directory(F.col("path")), F.col("entry"))).where("to IS NOT NULL")
    tried = written.select("path", (F.col("n") - F.col("place")).alias("turn"), F.posexplode(F.array("to", F.when(~F.col("to").endswith(".json"), F.concat("to", F.lit(".json"))))).alias("with_json", "to")).where("to IS NOT NULL")
    edges = tried.join(files.select(F.col("path").alias("to")), "to").groupBy("path", "turn").agg(F.min_by("to", "with_json").alias("to"))
    edges = edges.join(own.select(F.col("path").alias("to")), "to", "left_semi").select(F.col("path").alias("at"), "turn", "to").checkpoint()
    frontier = own.select(F.col("path").alias("config"), F.col("path").alias("at"), F.array().cast("array<int>").alias("rank"), F.array("path").alias("way"))
    levels = [frontier]
    while True:
        frontier = frontier.join(edges, "at").where("NOT array_contains(way, to)").select("config", F.col("to").alias("at"), F.concat("rank", F.array("turn")).alias("rank"), F.concat("way", F.array("to")).alias("way")).checkpoint()
        if frontier.isEmpty():
            break
        levels.append(frontier)
    closure = reduce(DataFrame.unionByName, levels).select("config", F.col("at").alias("path"), "rank").join(own, "path")
    base = closure.where("base_url IS NOT NULL").groupBy("config").agg(F.min_by(F.struct("path", "base_url"), "rank").alias("b"))
    patterns = closure.where("patterns IS NOT NULL").groupBy("config").agg(F.min_by(F.struct("path", "patterns"), "rank").alias("p"))
    joined = own.select(F.col("path").alias("config")).join(base, "config", "left").join(patterns, "config", "left")
    base_dir = joined_path(paths.directory(F.col("b.path")), F.col("b.base_url"))
    return joined.select("config", F.col("b.path").alias("base_in"), base_dir.alias("base_dir"), F.col("p.path").alias("paths_in"), F.when(F.col("b.path").isNotNull(), base_dir).otherwise(paths.directory(F.col("p.path"))).alias("paths_dir"), F.col("p.patterns").alias("patterns"))


def first_files(rows: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
    """(import_id, target): the first file that a base may stand for, as the importer's own tools try it.

    ``rows``: import_id, turn (bases of a lower one come first), base, typed (whether the importer is
    TypeScript, for which an output's name stands for its source). ``entries``: dir, target of packages' main entries.
    """
    # Files lie by their path less an ending that may be left out, so that a base is one row and not one for each ending.
    ends = lambda values: F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.lit(i).alias("place")) for i, e in enumerate(values)])).alias("e")
    plain = files.select("path", ends(("", *ES_EXTENSIONS))).where(F.endswith("path", F.col("e.end"))).select(F.expr("substring(path, 1, length(path) - length(e.end))").alias("key"), F.lit(False).alias("index"), "e.*")
    named = files.select("path", F.regexp_extract("path", "[^/]+$", 0).alias("name"), paths.directory(F.col("path")).alias("key")).where(F.startswith("name", F.lit("index.")))
    named = named.select("*", ends([f"index{e}" for e in ES_EXTENSIONS])).where((F.col("name") == F.col("e.end")) & (F.col("path") == child_path(F.col("key"), F.col("name")))).select("key", F.lit(True).alias("index"), "e.*")
    ending = F.regexp_extract("base", r"\.[cm]?jsx?$", 0)
    own = rows.select("import_id", "turn", F.col("base").alias("key"), F.lit("base").alias("of"), F.lit(None).cast("string").alias("output"))
    output = rows.where("typed").withColumn("output", ending).where(F.col("output").isin(*ES_SOURCES))
    output = output.select("import_id", "turn", F.expr("substring(base, 1, length(base) - length(output))").alias("key"), F.lit("output").alias("of"), "output")
    package = rows.join(entries.withColumnRenamed("dir", "base"), "base").withColumn("key", joined_path(F.col("base"), F.col("target"))).where("key IS NOT NULL")
    package = package.select("import_id", "turn", "key", F.lit("package").alias("of"), F.lit(None).cast("string").alias("output"))
    met = own.unionByName(output).unionByName(package).join(plain.unionByName(named), "key")
    # Sources of an output file come first, then the base itself, its package's entry, its index.
    turns = [(out, source) for out, sources in ES_SOURCES.items() for source in sources]
    source_place = reduce(lambda c, k: c.when((F.col("output") == turns[k][0]) & (F.col("end") == turns[k][1]), F.lit(k)), range(len(turns)), F)
    index, of, place = F.col("index"), F.col("of"), F.col("place")
    rank = (
        F.when((of == "output") & ~index & source_place.isNotNull(), F.array(F.lit(0), source_place)).when((of == "base") & ~index & (F.col("key") != ""), F.array(F.lit(1), place))
        .when((of == "package") & ~index, F.array(F.lit(2), place)).when((of == "base") & index, F.array(F.lit(3), place))
    )
    path = F.when(index, child_path(F.col("key"), F.col("end"))).otherwise(F.concat("key", "end"))
    return met.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("import_id").agg(F.min_by(path, F.struct("turn", "rank")).alias("target"))


def ecmascript_imports(imports: DataFrame, files: DataFrame, configs: DataFrame, packages: DataFrame) -> DataFrame:
    """``imports``: import_id, path, specifier; ``configs``: columns of CONFIG_SCHEMA; ``packages``: path of each
    package.json, name, entries (map from subpath to array of targets), dependencies (array of names).

    Order: relative path; absolute path (never); node: module; patterns of the governing
    configuration; its baseUrl (not for names of the runtime's modules); runtime; package of the
    repository; package declared above the file.
    """
    spec = F.col("specifier")
    rows = imports.withColumn("typed", F.col("path").rlike(r"\.[cm]?tsx?$")).withColumn("at", paths.directory(F.col("path")))
    rows = rows.withColumn("form", F.when(spec.rlike(r"^\.\.?(/|$)"), "relative").when(spec.startswith("/"), "absolute").when(spec.startswith("node:"), "node").otherwise("bare")).checkpoint()
    npm = packages.select(paths.directory(F.col("path")).alias("dir"), F.col("path").alias("manifest"), "name", "entries", "dependencies")
    mains = npm.select("dir", F.explode(F.expr("entries['.']")).alias("target"))
    none = F.lit(None).cast("string")
    result = lambda df, kind, target, method, reason: df.select("import_id", kind.alias("kind"), target.alias("target"), method.alias("method"), reason.alias("reason"))

    relative = rows.where("form = 'relative'").withColumn("base", joined_path(F.col("at"), spec))
    found = relative.join(first_files(relative.where("base IS NOT NULL").select("import_id", F.lit(0).alias("turn"), "base", "typed"), files, mains), "import_id", "left")
    hit = F.col("target").isNotNull()
    parts = [result(found, F.when(hit, "files").otherwise("unresolved"), F.col("target"), F.when(hit, "relative-path"), F.when(F.col("base").isNull(), "path escapes the repository").when(~hit, "no file matches the relative path"))]
    parts.append(result(rows.where("form = 'absolute'"), F.lit("unresolved"), none, none, F.lit("absolute paths are not portable")))
    parts.append(result(rows.where("form = 'node'"), F.lit("builtin"), none, none, none))

    bare = rows.where("form = 'bare'")
    head = F.split("specifier", "/")
    size = F.when(spec.startswith("@"), 2).otherwise(1)
    rest = F.array_join(F.slice(head, size + 1, F.size(head)), "/")
    bare = bare.withColumn("builtin", head[0].isin(*NODE_BUILTIN)).withColumn("package", F.array_join(F.slice(head, F.lit(1), size), "/")).withColumn("subpath", F.when(rest == "", ".").otherwise(F.concat(F.lit("./"), rest)))
    governing = bare.select("path").distinct().select("path", F.posexplode(paths.ancestors(F.col("path"))).alias("steps", "dir")).select("path", "steps", F.posexplode(F.array(*[child_path(F.col("dir"), F.lit(n)) for n in ("tsconfig.json", "jsconfig.json")])).alias("which", "config"))
    governing = governing.join(files.select(F.col("path").alias("config")), "config").groupBy("path").agg(F.min_by("config", F.struct("steps", "which")).alias("config"))
    settings = effective_configs(configs, files).checkpoint()
    ruled = bare.join(governing, "path", "left").join(settings, "config", "left").checkpoint()

    each = ruled.where("paths_dir IS NOT NULL").select("import_id", "specifier", "paths_dir", "paths_in", "typed", F.posexplode("patterns").alias("place", "p")).select("*", "p.*")
    head_, tail = F.substring_index("pattern", "*", 1), F.substring_index("pattern", "*", -1)
    star = F.col("pattern").contains("*")
    fits = F.when(star, (F.length("specifier") >= F.length(head_) + F.length(tail)) & F.startswith("specifier", head_) & F.endswith("specifier", tail)).otherwise(spec == F.col("pattern"))
    matched = each.where(fits).groupBy("import_id", "specifier", "paths_dir", "paths_in", "typed").agg(F.min_by(F.struct("pattern", "targets"), F.struct(star, -F.length(head_), "place")).alias("m")).select("import_id", "specifier", "paths_dir", "paths_in", "typed", "m.*")
    taken = F.expr("substring(specifier, length(substring_index(pattern, '*', 1)) + 1, length(specifier) - length(pattern) + 1)")
    filled = matched.select("import_id", "paths_dir", "typed", F.when(star, taken).alias("taken"), F.posexplode("targets").alias("turn", "to"))
    filled = filled.withColumn("base", joined_path(F.col("paths_dir"), F.coalesce(F.replace("to", F.lit("*"), F.col("taken")), "to"))).where("base IS NOT NULL")
    alias = matched.select("import_id", "pattern").join(first_files(filled.select("import_id", "turn", "base", "typed"), files, mains).withColumnRenamed("target", "alias_target"), "import_id", "left")
    based = ruled.where("NOT builtin AND base_dir IS NOT NULL").select("import_id", F.lit(0).alias("turn"), joined_path(F.col("base_dir"), spec).alias("base"), "typed").where("base IS NOT NULL")
    based = first_files(based, files, mains).withColumnRenamed("target", "base_target")

    own = npm.where("name IS NOT NULL").groupBy(F.col("name").alias("package")).agg(F.min_by(F.struct("dir", "entries"), "manifest").alias("w")).select("package", F.col("w.dir").alias("own_dir"), F.col("w.entries").alias("own_entries"))
    owned = ruled.select("import_id", "package", "subpath").join(own, "package")
    entries = owned.select("import_id", "own_dir", F.posexplode(F.expr("own_entries[subpath]")).alias("turn", "to")).withColumn("path", joined_path(F.col("own_dir"), F.col("to")))
    entries = entries.join(files.select("path"), "path").groupBy("import_id").agg(F.min_by("path", "turn").alias("entry_target"))
    owned = owned.select("import_id", F.lit(True).alias("owned")).join(entries, "import_id", "left")
    needs = npm.select("dir", F.explode("dependencies").alias("package")).distinct()
    declared = ruled.select("import_id", "package", F.explode(paths.ancestors(F.col("path"))).alias("dir")).join(needs, ["dir", "package"]).select("import_id").distinct().withColumn("declared", F.lit(True))

    all_ = ruled.join(alias, "import_id", "left").join(based, "import_id", "left").join(owned, "import_id", "left").join(declared, "import_id", "left")
    missed = F.concat(F.lit("tsconfig path "), "pattern", F.lit(" in "), "paths_in", F.lit(" matched but no target file exists"))
    cases = [  # condition, kind, target, method, reason
        (F.col("alias_target").isNotNull(), "files", F.col("alias_target"), F.concat(F.lit("tsconfig-paths:"), "paths_in", F.lit("#"), "pattern"), none),
        (F.col("base_target").isNotNull(), "files", F.col("base_target"), F.concat(F.lit("tsconfig-base-url:"), "base_in"), none),
        (F.col("builtin"), "builtin", none, none, none),
        (F.col("entry_target").isNotNull(), "files", F.col("entry_target"), F.lit("workspace-package-entry"), none),
        (F.col("owned"), "unresolved", none, none, F.concat(F.lit("workspace package "), "package", F.lit(" has no existing entry for "), "subpath")),
        (F.col("declared"), "dependency", F.col("package"), F.lit("declared-package"), none),
        (F.lit(True), "unresolved", none, none, F.coalesce(missed, F.concat(F.lit("package "), "package", F.lit(" is not declared in any package.json above the file")))),
    ]
    pick = lambda k: reduce(lambda c, case: c.when(case[0], case[k] if isinstance(case[k], Column) else F.lit(case[k])), cases, F)
    parts.append(result(all_, pick(1), pick(2), pick(3), pick(4)))
    return reduce(DataFrame.unionByName, parts)


# Languages whose imports name paths from a source root that nothing declares

#: How sure a file is that was found by the end of its path.
INFERRED_ROOT = 0.9
# Names that belong to the platform.
JAVA_PLATFORM, CSHARP_PLATFORM = r"^(java|javax|jdk|sun|com\.sun|org\.w3c|org\.xml)\.", r"^(System|Microsoft)(\.|$)"
# The standard library of Ruby.
RUBY_LIBRARY = (
    "abbrev", "base64", "benchmark", "bigdecimal", "cgi", "csv", "date", "delegate", "digest", "English", "erb", "etc", "fileutils", "find", "forwardable", "io/console", "ipaddr", "json", "logger",
    "monitor", "net/http", "objspace", "observer", "open-uri", "open3", "openssl", "optparse", "ostruct", "pathname", "pp", "prettyprint", "pstore", "psych", "rbconfig", "securerandom", "set", "shellwords",
    "singleton", "socket", "stringio", "strscan", "tempfile", "time", "timeout", "tmpdir", "tsort", "uri", "weakref", "yaml", "zlib",
)


def endings(rows: DataFrame, column: str) -> DataFrame:
    """(suffix, n, found): every ending of the paths at a slash, how many paths have it, and the first."""
    parts = F.split(column, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))
    return rows.select(F.col(column).alias("found"), F.explode(ends).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"), F.min("found").alias("found"))


def suffix_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, kind, targets, confidence, method, reason) of Java, C#, Ruby and PHP imports.

    ``imports``: import_id, path, language, form, specifier. A class or a required file is the one
    file whose path ends so; several are no answer. A Java package is all files of the one directory,
    an inner class its outer one's file; Ruby prefers a lib folder; PHP drops leading namespaces
    until a file is found. Relative paths are looked up as they are.
    """
    ext = {"java": ".java", "ruby": ".rb", "php": ".php"}
    wanted = files.where(F.regexp_extract("path", r"\.[^./]+$", 0).isin(*ext.values())).select("path").distinct().checkpoint()
    index = endings(wanted, "path").checkpoint()
    spec = F.col("specifier")
    none = F.lit(None).cast("string")

    def given(df: DataFrame, found: Column, confidence: float, method: Column | str, reason: Column) -> DataFrame:
        """``found``: array of paths, null where there is none."""
        hit = found.isNotNull()
        return df.select("import_id", F.when(hit, "files").otherwise("unresolved").alias("kind"), found.alias("targets"), F.when(hit, confidence).alias("confidence"), F.when(hit, method if isinstance(method, Column) else F.lit(method)).alias("method"), F.when(~hit, reason).alias("reason"))

    def builtin(df: DataFrame) -> DataFrame:
        return df.select("import_id", F.lit("builtin").alias("kind"), F.lit(None).cast("array<string>").alias("targets"), F.lit(None).cast("double").alias("confidence"), none.alias("method"), none.alias("reason"))

    def by_ending(df: DataFrame, tried: Column, several: Column, missing: Column, method: str, sure_only: int = 0) -> DataFrame:
        """The first ending that a file has decides; the first ``sure_only`` endings count only for one file."""
        each = df.select("import_id", F.posexplode(tried).alias("place", "suffix")).join(index, "suffix").where((F.col("place") >= sure_only) | (F.col("n") == 1))
        best = each.groupBy("import_id").agg(F.min_by(F.struct("n", "found"), "place").alias("b"))
        rows = df.join(best, "import_id", "left")
        return given(rows, F.when(F.col("b.n") == 1, F.array("b.found")), INFERRED_ROOT, method, F.when(F.col("b").isNull(), missing).otherwise(several))

    def by_path(df: DataFrame, tried: Column, method: str, missing: str) -> DataFrame:
        each = df.select("import_id", F.posexplode(tried).alias("place", "path")).join(wanted, "path").groupBy("import_id").agg(F.min_by("path", "place").alias("found"))
        rows = df.join(each, "import_id", "left")
        return given(rows, F.when(F.col("found").isNotNull(), F.array("found")), 1.0, method, F.lit(missing))

    at = paths.directory(F.col("path"))
    java = imports.where("language = 'java'")
    platform = java.where(spec.rlike(JAVA_PLATFORM))
    package = java.where(~spec.rlike(JAVA_PLATFORM) & spec.endswith(".*")).withColumn("suffix", F.replace(F.regexp_replace("specifier", r"\.\*$", ""), F.lit("."), F.lit("/")))
    held = wanted.where(F.col("path").endswith(".java")).groupBy(paths.directory(F.col("path")).alias("dir")).agg(F.array_sort(F.collect_list("path")).alias("held"))
    folders = endings(held.select("dir"), "dir")
    package = package.join(folders, "suffix", "left").join(held.withColumnRenamed("dir", "found"), "found", "left")
    parts = [
        builtin(platform),
        given(package, F.when(F.col("n") == 1, F.col("held")), INFERRED_ROOT, "java-package", F.when(F.col("n") > 1, F.concat(F.lit("package "), spec, F.lit(" matches several directories"))).otherwise(F.concat(F.lit("no package directory for "), spec))),
    ]
    names = F.split("specifier", r"\.")
    outer = F.when(F.size(names) > 1, F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(1))), "/"), F.lit(".java")))
    classes = java.where(~spec.rlike(JAVA_PLATFORM) & ~spec.endswith(".*"))
    parts.append(by_ending(classes, F.array_compact(F.array(F.concat(F.array_join(names, "/"), F.lit(".java")), outer)), F.concat(F.lit("class "), spec, F.lit(" matches several files")), F.concat(F.lit("class "), spec, F.lit(" is not in this repository")), "java-class-path"))

    csharp = imports.where("language = 'csharp'")
    parts += [builtin(csharp.where(spec.rlike(CSHARP_PLATFORM))), given(csharp.where(~spec.rlike(CSHARP_PLATFORM)), F.lit(None).cast("array<string>"), 0.0, "", F.lit("C# namespaces are not tied to files"))]

    ruby = imports.where("language = 'ruby'").withColumn("bare", F.regexp_replace("specifier", r"\.rb$", ""))
    near = F.col("bare").rlike(r"^\.\.?/")
    file = F.concat("bare", F.lit(".rb"))
    parts += [by_path(ruby.where(near), F.array(joined_path(at, file)), "ruby-require-relative", "no file matches the relative require"), builtin(ruby.where(~near & F.col("bare").isin(*RUBY_LIBRARY)))]
    loaded = ruby.where(~near & ~F.col("bare").isin(*RUBY_LIBRARY))
    parts.append(by_ending(loaded, F.array(F.concat(F.lit("lib/"), file), file), F.concat(file, F.lit(" matches several files")), F.concat("bare", F.lit(" is not a file in this repository (a gem?)")), "ruby-load-path", sure_only=1))

    php = imports.where("language = 'php'")
    required = F.array_compact(F.array(joined_path(at, spec), F.when(~spec.startswith("."), joined_path(F.lit(""), spec))))
    parts.append(by_path(php.where("form = 'require'"), required, "php-require", "no file matches the required path"))
    spaces = F.split(F.regexp_replace("specifier", r"^\\", ""), r"\\")
    tried = F.transform(F.sequence(F.size(spaces), F.lit(1), F.lit(-1)), lambda n: F.concat(F.array_join(F.slice(spaces, -n, n), "/"), F.lit(".php")))
    parts.append(by_ending(php.where("form <> 'require'"), tried, F.concat(F.lit("class "), spec, F.lit(" matches several files")), F.concat(F.lit("class "), spec, F.lit(" is not in this repository")), "php-class-path"))
    return reduce(DataFrame.unionByName, parts)
