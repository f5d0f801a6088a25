"""Origins, fossils, touched symbols, stories and dead intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.levels import round2, round3
from ..functions.stored import settled
from . import graph

# What each kind of signal adds, and how far a commit's words reach.
WORKAROUND, UNSUPPORTED, OVERDUE, UNCONFIRMED, MOST = 0.3, 0.25, 0.2, 0.1, 0.8
BROAD_FILES, FOCUSED_FILES, REWORKED_AFTER, STALE_DAYS = 20, 3, 3, 365


def symbol_origins(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, commit_id, confidence, level, copied): the introduction of each symbol, through copies if need be.

    A claim followed through copies is no surer than its weakest link.
    """
    copies = relations.where("relation = 'COPIED_FROM'").select(F.col("source_id").alias("id"), F.col("target_id").alias("origin"), "confidence", "level")
    chains = graph.copy_chain(copies).select("id", "origin", F.col("confidence").alias("chain_confidence"), "inferred")
    born = relations.where("relation = 'INTRODUCED_BY'").groupBy(F.col("source_id").alias("origin")).agg(F.max_by(F.struct("target_id", "level", F.col("confidence").cast("double").alias("confidence")), "confidence").alias("b"))
    table = symbols.select("id").join(chains, "id", "left").withColumn("copied", F.col("origin").isNotNull())
    table = table.withColumn("origin", F.coalesce("origin", "id")).join(born, "origin")
    level = F.when(F.coalesce("inferred", F.lit(False)), "INFERRED").otherwise(F.col("b.level"))
    return table.select("id", F.col("b.target_id").alias("commit_id"), F.least("b.confidence", F.coalesce("chain_confidence", F.lit(1.0))).alias("confidence"), level.alias("level"), "copied")


def fossils(symbols: DataFrame, origins: DataFrame, versions: DataFrame, commits: DataFrame) -> DataFrame:
    """symbols with committed_at of their introduction, level, confidence and changes_since.

    The version that a symbol arrived with is no change: a copy's first, an original's introduction.
    """
    dates = commits.select(F.col("id").alias("commit_id"), "committed_at")
    own = versions.select("symbol_id", "commit_id").distinct().join(dates, "commit_id")
    first = own.groupBy(F.col("symbol_id").alias("id")).agg(F.min_by("commit_id", F.struct("committed_at", "commit_id")).alias("first"))
    table = origins.join(first, "id", "left").withColumn("arrival", F.when(F.col("copied"), F.col("first")).otherwise(F.col("commit_id")))
    later = own.select(F.col("symbol_id").alias("id"), F.col("commit_id").alias("changed")).join(table.select("id", "arrival"), "id").where("changed <> arrival").groupBy("id").agg(F.count("*").alias("changes_since"))
    return symbols.join(table.join(dates, "commit_id"), "id").join(later, "id", "left").fillna(0, ["changes_since"])


def touched_symbols(symbols: DataFrame, versions: DataFrame, relations: DataFrame, in_range: DataFrame) -> DataFrame:
    """(id, change, callers) of symbols that a range of commits changes: new, copied or changed."""
    marked = versions.join(in_range.distinct().withColumn("inside", F.lit(True)), "commit_id", "left")
    sums = marked.groupBy(F.col("symbol_id").alias("id")).agg(F.bool_and(F.coalesce("inside", F.lit(False))).alias("born"), F.bool_or(F.coalesce("inside", F.lit(False))).alias("hit")).where("hit")
    copies = relations.where("relation = 'COPIED_FROM'").select(F.col("source_id").alias("id"), F.lit(True).alias("copied")).distinct()
    callers = relations.where("relation = 'CALLS' AND source_id <> target_id").groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("callers"))
    table = symbols.select("id").join(sums, "id").join(copies, "id", "left").join(callers, "id", "left")
    change = F.when(~F.col("born"), "changed").when(F.col("copied"), "copied").otherwise("new")
    return table.select("id", change.alias("change"), F.coalesce("callers", F.lit(0)).alias("callers"))


# The order in which kinds of change are shown.
TOUCH_ORDER = ("new", "renamed", "moved", "copied", "changed")


def top_touched(touched: DataFrame, places: DataFrame, covered: DataFrame, limit: int) -> DataFrame:
    """``touched`` (id, change, ...) with path, start_line and share: new symbols first, then the least covered, by path and line.

    ``places``: id, path, start_line; ``covered``: id, found, hit. What no report covers comes last of its kind.
    """
    kind = F.array_position(F.array(*map(F.lit, TOUCH_ORDER)), F.col("change"))
    rows = touched.join(places, "id").join(covered.where("found > 0").select("id", (F.col("hit") / F.col("found")).alias("share")), "id", "left")
    return rows.orderBy(kind, F.coalesce("share", F.lit(2.0)), "path", "start_line", "id").limit(limit)


def changed_by_impact(changed: DataFrame, edges: DataFrame, limit: int = 25) -> DataFrame:
    """path and impact of the first ``limit`` changed files by path, those with most dependents first.

    ``changed``: file_id, path; ``edges``: source, target, confidence. Only what is shown is traced.
    """
    shown = changed.distinct().orderBy("path").limit(limit).checkpoint()
    reached = graph.dependents(edges, roots=shown.select(F.col("file_id").alias("root")))
    sizes = reached.groupBy(F.col("root").alias("file_id")).agg(F.count("*").alias("impact"))
    return shown.join(sizes, "file_id", "left").select("path", F.coalesce("impact", F.lit(0)).alias("impact")).orderBy(F.desc("impact"), "path")


def symbol_stories(versions: DataFrame, commits: DataFrame, defects: DataFrame, names: DataFrame, persons: DataFrame, calls: DataFrame, owners: int = 3) -> DataFrame:
    """(symbol_id, changes, authors, fixes, callers, owners, first_day, last_day).

    Authors are people, whatever names they used (``names``: name_key, person_key; ``persons``:
    person_key, person). ``owners`` names those with most commits and their share. ``calls``:
    symbol_id, caller, each counted once.
    """
    # What belongs to a commit comes together before it meets the symbols, which then move once.
    who = commits.select(F.col("id").alias("commit_id"), text.name_key(F.col("author_name")).alias("name_key"), "committed_at").join(names, "name_key").drop("name_key")
    made = settled(who.join(defects.select("commit_id", F.lit(1).alias("fix")), "commit_id", "left"))
    changed = settled(versions.select("symbol_id", "commit_id").distinct())
    by_person = settled(changed.join(made, "commit_id").groupBy("symbol_id", "person_key").agg(F.count("*").alias("n"), F.count("fix").alias("fix"), F.min("committed_at").alias("first_at"), F.max("committed_at").alias("last_at")).join(persons.select("person_key", "person"), "person_key"))
    shares = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "person", "person_key")))
    summed = settled(by_person.groupBy("symbol_id").agg(F.sum("n").alias("changes"), F.count("*").alias("authors"), F.sum("fix").alias("fixes"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), shares.alias("shares")))
    named = F.transform(F.slice("shares", 1, owners), lambda s: F.concat(s["person"], F.lit(" "), round3(-s["less"] / F.col("changes")).cast("string")))
    called = settled(calls.groupBy("symbol_id").agg(F.countDistinct("caller").alias("callers")))
    return summed.join(called, "symbol_id", "left").select("symbol_id", "changes", "authors", "fixes", F.coalesce("callers", F.lit(0)).alias("callers"), F.array_join(named, "; ").alias("owners"), text.day(F.col("first_at")).alias("first_day"), text.day(F.col("last_at")).alias("last_day"))


def longest_untouched(symbols: DataFrame, versions: DataFrame, commits: DataFrame, limit: int = 20) -> DataFrame:
    """Symbols (id, path, start_line, ...) with last_at, the longest untouched first."""
    last = versions.join(commits.select(F.col("id").alias("commit_id"), "committed_at"), "commit_id").groupBy(F.col("symbol_id").alias("id")).agg(F.max("committed_at").alias("last_at"))
    return symbols.join(last, "id").orderBy("last_at", "path", "start_line", "id").limit(limit)


def workaround(message: Column) -> Column:
    """Struct (phrase, in_first_line) of the first wording on a line that doesn't remove something before it; null if none."""
    return F.get(F.filter(F.transform(F.split(message, "\n"), lambda line, i: F.struct(_unremoved(line).alias("phrase"), (i == 0).alias("in_first_line"))), lambda m: m["phrase"] != ""), F.lit(0))


def _unremoved(line: Column) -> Column:
    """The first wording that no removal word precedes on its line; '' if none."""
    removal = text.REMOVAL.removeprefix("(?i)")
    return F.regexp_extract(line, f"(?i)^(?:(?!{removal}).)*?({text.WORKAROUND})", 1)


def dead_intent(files: DataFrame, changes: DataFrame, commits: DataFrame, minimums: DataFrame, now: str, stale_days: int = STALE_DAYS) -> DataFrame:
    """(file_id, reasons, first_at, confidence) of files that may exist for a reason that is gone.

    Wording of a commit is put down to the files it changed if they are few; unsupported versions,
    passed deadlines and long silence add to it, each kind once. ``minimums``: runtime, major, minor.
    """
    message = F.concat_ws("\n", "subject", "body")
    breadth = changes.groupBy("commit_id").agg(F.count("*").alias("n"))
    worded = commits.select(F.col("id").alias("commit_id"), "committed_at", message.alias("message")).withColumn("match", workaround(F.col("message"))).where("match IS NOT NULL")
    flagged = worded.join(breadth, "commit_id").where(F.col("n") <= F.when(F.col("match.in_first_line"), BROAD_FILES).otherwise(FOCUSED_FILES))
    named = flagged.select("commit_id", F.explode(text.version_references(F.col("message"))).alias("v")).select("commit_id", "v.*")
    least = F.broadcast(minimums.select("runtime", F.col("major").alias("least_major"), F.col("minor").alias("least_minor")))  # four runtimes
    old = named.join(least, "runtime").where(text.is_below(F.col("major"), F.col("minor"), F.col("least_major"), F.col("least_minor"))).select("commit_id").distinct().withColumn("old", F.lit(True))
    due = flagged.select("commit_id", F.explode(text.deadlines(F.col("message"))).alias("written")).where(text.deadline_end(F.col("written")) < F.lit(now).cast("date")).select("commit_id").distinct().withColumn("overdue", F.lit(True))
    signals = flagged.select("commit_id", "committed_at").join(old, "commit_id", "left").join(due, "commit_id", "left")
    path = F.col("path")
    target = files.where("NOT deleted").where(F.coalesce(paths.is_code(path), F.lit(False)) & ~paths.is_test(path) & ~paths.is_illustrative(path) & ~paths.is_generated(path))
    hit = changes.where("status <> 'deleted'").select("commit_id", "file_id").join(target.select(F.col("id").alias("file_id")), "file_id", "left_semi").join(signals, "commit_id")
    found = hit.groupBy("file_id").agg(F.countDistinct("commit_id").alias("reasons"), F.min("committed_at").alias("first_at"), F.max("committed_at").alias("last_flagged"), F.bool_or(F.coalesce("old", F.lit(False))).alias("old"), F.bool_or(F.coalesce("overdue", F.lit(False))).alias("overdue"))
    later = found.join(changes.select("file_id", F.col("committed_at").alias("changed_at")), "file_id").groupBy("file_id").agg(F.count_if(F.col("changed_at") > F.col("last_flagged")).alias("reworked"), F.max("changed_at").alias("last_at"))
    silent = F.datediff(F.lit(now).cast("date"), F.col("last_at")) >= stale_days
    total = F.lit(WORKAROUND) + F.when(F.col("old"), UNSUPPORTED).otherwise(0.0) + F.when(F.col("overdue"), OVERDUE).otherwise(0.0) + F.when(silent, UNCONFIRMED).otherwise(0.0)
    return found.join(later, "file_id").where(F.col("reworked") < REWORKED_AFTER).select("file_id", "reasons", "first_at", round2(F.least(F.lit(MOST), total)).alias("confidence"))
