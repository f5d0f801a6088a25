"""Reads and joins that the analyses share: lookups, ranked candidates, containment, uniqueness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.stored import settled, written

LIMIT = 20


def commits_by_sha_prefix(commits: DataFrame, prefix: str, limit: int = LIMIT) -> DataFrame:
    return commits.where(F.col("sha").startswith(prefix.lower())).orderBy("id").limit(limit)


def symbols_by_name(symbols: DataFrame, name: str, limit: int = LIMIT) -> DataFrame:
    return symbols.where((F.col("name") == name) | (F.col("qualified_name") == name)).orderBy(F.desc("current"), "id").limit(limit)


def search_files(files: DataFrame, part: str, limit: int = LIMIT) -> DataFrame:
    """Live files first; case doesn't matter."""
    return files.where(F.lower("path").contains(part.lower())).orderBy("deleted", "path").limit(limit)


def runtime_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence of runtime versions that manifests declare: its rows with path and runtime, read from the locator."""
    rows = evidence.where(F.col("locator").contains("#runtime:"))
    return rows.withColumn("path", F.substring_index("locator", "#runtime:", 1)).withColumn("runtime", F.substring_index("locator", "#runtime:", -1))


def dependencies_by_name(dependencies: DataFrame, name: str, ecosystem: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Dependencies of that very name, of one ecosystem or of all, in order of ecosystem and id."""
    found = dependencies.where(F.col("name") == name)
    return (found.where(F.col("ecosystem") == ecosystem) if ecosystem else found).orderBy("ecosystem", "id").limit(limit)


def recent_commits(commits: DataFrame, limit: int = LIMIT) -> DataFrame:
    return commits.orderBy(F.desc("committed_at"), F.desc("id")).limit(limit)


def commits_mentioning(commits: DataFrame, words: list[str], limit: int = LIMIT) -> DataFrame:
    """Commits with any of the words in subject or body, newest first; no words, no commits."""
    tests = [F.lower(c).contains(w.lower()) for w in words for c in ("subject", "body")]
    return recent_commits(commits.where(reduce(lambda a, b: a | b, tests, F.lit(False))), limit)


def binding_may_reach(imported: Column, qualified: Column, defined: Column) -> Column:
    """Whether an imported name may give access to a symbol; only another definition of the file surely doesn't."""
    dot = F.lit(".")
    return imported.isin("*", "default") | (imported == qualified) | F.startswith(qualified, F.concat(imported, dot)) | F.startswith(imported, F.concat(qualified, dot)) | ~F.array_contains(defined, imported)


def stale(rows: DataFrame, synced: Column, updated: Column) -> DataFrame:
    return rows.where(synced.isNull() | (synced < updated))


def symbols_changed_in(versions: DataFrame, symbols: DataFrame, commits: DataFrame) -> DataFrame:
    """(commit_id, symbol_id, qualified_name) for the given commit_ids, a semi-join instead of an IN list."""
    changed = versions.join(commits, "commit_id", "left_semi").select("commit_id", "symbol_id").distinct()
    return changed.join(symbols.select(F.col("id").alias("symbol_id"), "qualified_name"), "symbol_id").select("commit_id", "symbol_id", "qualified_name")


def commit_discussions(relations: DataFrame) -> DataFrame:
    """Links between commits and discussions, whichever end the commit is."""
    linked = relations.where(F.col("relation").isin("RESOLVED_BY", "IMPLEMENTED_BY", "REFERENCES"))
    ours = F.col("source_type") == "commit"
    return linked.select(
        F.when(ours, F.col("source_id")).otherwise(F.col("target_id")).alias("commit_id"), F.when(ours, F.col("target_type")).otherwise(F.col("source_type")).alias("type"),
        F.when(ours, F.col("target_id")).otherwise(F.col("source_id")).alias("number"), "relation", "level", "confidence",
    )


def identical_copies(texts: DataFrame) -> DataFrame:
    """(doc_id, first_id): documents whose text an earlier one has; texts meet by digest, not by value."""
    hashed = texts.select("doc_id", F.sha2("text", 256).alias("digest"))
    first = hashed.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    return hashed.join(first, "digest").where("doc_id <> first_id").select("doc_id", "first_id")


def identical_symbols(versions: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, commit_id, copied_from): the latest earlier version of equal content, name and kind in another file.

    In order of (commit, symbol), versions of one content fall into runs of one file each; what a
    row was copied from is the last of the run before its own. So no pairs are made within a group.
    """
    rows = versions.join(symbols.select(F.col("id").alias("symbol_id"), "file_id", "name", "kind"), "symbol_id")
    group = ["content_hash", "name", "kind"]
    order = Window.partitionBy(*group).orderBy("commit_id", "symbol_id")
    turn = F.when(F.lag("file_id").over(order) == F.col("file_id"), 0).otherwise(1)
    rows = rows.withColumn("turn", turn).withColumn("run", F.sum("turn").over(order))
    ends = rows.groupBy(*group, "run").agg(F.max_by("symbol_id", F.struct("commit_id", "symbol_id")).alias("copied_from")).withColumn("run", F.col("run") + 1)
    return rows.join(ends, [*group, "run"]).select("symbol_id", "commit_id", "copied_from")


def unused(rows: DataFrame, uses: list[DataFrame]) -> DataFrame:
    """Rows whose id none of ``uses`` has."""
    return reduce(lambda left, used: left.join(used.where("id IS NOT NULL"), "id", "left_anti"), uses, rows)


#: Lines that share a bin where lines meet the symbols around them.
LINE_BIN = 64


def innermost(calls: DataFrame, symbols: DataFrame, named: bool = False) -> DataFrame:
    """(file_id, line, callee, caller_id): the shortest symbol around each call line; ties to the smaller id.

    With ``named`` only symbols whose name is the callee count.

    Lines and spans meet by bins of lines, so a long file's calls aren't held against all its symbols.
    """
    names = [F.col("name").alias("callee")] if named else []
    spans = symbols.where("start_line <= end_line").select("file_id", "id", "start_line", "end_line", *names, F.explode(F.expr(f"sequence(start_line div {LINE_BIN}, end_line div {LINE_BIN})")).alias("bin"))
    around = calls.withColumn("bin", F.expr(f"line div {LINE_BIN}")).join(spans, ["file_id", "bin", *(["callee"] if named else [])]).where("line BETWEEN start_line AND end_line")
    return around.groupBy("file_id", "line", "callee").agg(F.min_by("id", F.struct(F.col("end_line") - F.col("start_line"), F.col("id"))).alias("caller_id"))


def first_existing(tried: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and target: of the candidate paths (path, place) the first that ``known`` (path, target) has."""
    return tried.join(known, "path").groupBy(*by).agg(F.min_by("target", F.struct("place", "target")).alias("target"))


def unique_suffixes(files: DataFrame, segments: int) -> DataFrame:
    """(suffix, file_id) of path endings of up to ``segments`` parts that one file alone has."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(segments))), lambda n: F.array_join(F.slice(parts, -n, n), "/"))
    return files.select("id", F.explode(ends).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"), F.min("id").alias("file_id")).where("n = 1").drop("n")


def nearest_above(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """files with the deepest of ``dirs`` (dir) that is above the path."""
    above = files.select("*", F.posexplode(paths.ancestors(F.col("path"))).alias("steps", "dir"))
    return above.join(dirs, "dir").groupBy(*files.columns).agg(F.min_by("dir", "steps").alias("dir"))


def reverted_commits(commits: DataFrame) -> DataFrame:
    """(id, target): the commit that a message says it reverts, if the written prefix names one alone.

    Prefixes and hashes meet by their first seven digits, so the prefix test runs within small groups.
    """
    written = commits.select("id", F.explode(F.slice(F.regexp_extract_all("body", F.lit(text.REVERTED_SHA), F.lit(1)), 1, 1)).alias("prefix"))
    known = commits.select(F.col("id").alias("target"), "sha", F.substring("sha", 1, 7).alias("head"))
    found = written.withColumn("head", F.substring("prefix", 1, 7)).join(known, "head").where(F.startswith("sha", "prefix"))
    return found.groupBy("id").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")


def mutually_unique(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Pairs that share ``by`` where each side has one row alone."""
    one = lambda df: df.groupBy(*by).agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in df.columns if c not in by]).where("n = 1").drop("n")
    return one(left).join(one(right), by)


def one_per(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def dangling(relations: DataFrame, entities: dict[str, DataFrame], ends: list[tuple[str, str]]) -> DataFrame:
    """Links one of whose ends doesn't exist, each link once."""
    found = []
    for end, kind in ends:
        known = entities[kind].select(F.col("id").alias(f"{end}_id"))
        found.append(relations.where(F.col(f"{end}_type") == kind).join(known, f"{end}_id", "left_anti").select("id"))
    return reduce(DataFrame.unionByName, found).distinct()


def follow_renames(symbols: DataFrame, renames: DataFrame) -> DataFrame:
    """(id, file_id, now): the file that each symbol is in after all renames, in order of time.

    ``symbols``: id, file_id, born_at; ``renames``: rename_id, from_id, to_id, at. A rename takes the
    symbols that the old file has then to the new one, unless the new one has symbols already; what is
    born in a file later stays. Renames that share no file don't wait for each other: a round does
    all that are the first one left for both their files, so rounds are the longest chain of renames
    and not their number. Only symbols of renamed files move.
    """
    symbols = settled(symbols.select("id", "file_id", "born_at"))
    left = settled(renames.where("from_id <> to_id AND at IS NOT NULL").select("rename_id", "from_id", "to_id", "at").distinct())
    named = left.select(F.col("from_id").alias("file_id")).unionByName(left.select(F.col("to_id").alias("file_id"))).distinct()
    state = settled(symbols.join(named, "file_id", "left_semi").select("id", F.col("file_id").alias("now"), F.col("born_at").alias("since")))
    while not left.isEmpty():
        turn = F.struct("at", "rename_id")
        ends = left.select(F.col("from_id").alias("file"), turn.alias("turn")).unionByName(left.select(F.col("to_id").alias("file"), turn.alias("turn")))
        first = ends.groupBy("file").agg(F.min("turn").alias("turn"))
        ready = written(left.join(first.select(F.col("file").alias("from_id"), F.col("turn").alias("a")), "from_id").join(first.select(F.col("file").alias("to_id"), F.col("turn").alias("b")), "to_id").where((F.col("a") == turn) & (F.col("b") == turn)).select("rename_id", "from_id", "to_id", "at"))
        busy = ready.join(state, F.col("to_id") == F.col("now")).where("since <= at").select("rename_id").distinct()
        move = ready.join(busy, "rename_id", "left_anti").select(F.col("from_id").alias("now"), "to_id", "at")
        moved = state.join(move, "now", "left")
        goes = F.col("to_id").isNotNull() & (F.col("since") <= F.col("at"))
        state = written(moved.select("id", F.when(goes, F.col("to_id")).otherwise(F.col("now")).alias("now"), F.when(goes, F.col("at")).otherwise(F.col("since")).alias("since")))
        left = settled(left.join(ready.select("rename_id"), "rename_id", "left_anti"))
    return symbols.select("id", "file_id").join(state.select("id", "now"), "id", "left").select("id", "file_id", F.coalesce("now", "file_id").alias("now"))
