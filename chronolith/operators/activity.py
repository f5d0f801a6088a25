"""File activity across renames, import reach, defect classification, hotspots and risk."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.levels import level_name, level_rank, round3

REACH_DEPTH = 5


def rename_lineage(roots: DataFrame, changes: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(root, file_id, until): each file with the paths it was renamed from, each up to its rename.

    A level is one join of the frontier with the rename rows (a small part of all changes); a
    predecessor that is reached twice keeps its first bound: least hops, then earliest rename. Cycles
    end there, and without ``max_hops`` the loop ends when no new predecessor is found.
    """
    renames = changes.where("status = 'renamed' AND previous_file_id IS NOT NULL").select("file_id", F.col("previous_file_id").alias("previous"), F.col("committed_at").alias("renamed_at"), F.col("id").alias("change_id"))
    seen = frontier = roots.select(F.col("id").alias("root"), F.col("id").alias("file_id"), F.lit(None).cast("timestamp_ntz").alias("until"))
    first = Window.partitionBy("root", "previous").orderBy("renamed_at", "change_id")
    for _ in count() if max_hops is None else range(max_hops):
        step = frontier.join(renames, "file_id").where("until IS NULL OR renamed_at <= until")
        step = step.withColumn("n", F.row_number().over(first)).where("n = 1").select("root", F.col("previous").alias("file_id"), F.col("renamed_at").cast("timestamp_ntz").alias("until"))
        # Written out, so that a level's plan doesn't hold all levels before it.
        frontier = step.join(seen.select("root", "file_id"), ["root", "file_id"], "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def is_pure_rename(unknown: int = 0) -> Column:
    """A rename that changed no line; ``unknown`` is what a binary file's missing counts stand for."""
    return (F.col("status") == "renamed") & (F.coalesce("additions", F.lit(unknown)) + F.coalesce("deletions", F.lit(unknown)) == 0)


def lineage_changes(files: DataFrame, changes: DataFrame, since: str | None = None, max_hops: int | None = None) -> DataFrame:
    """Content changes of each live file and its former paths: root, path and the change's columns."""
    live = files.where("NOT deleted")
    lineage = rename_lineage(live, changes, max_hops)
    counted = changes.where(~is_pure_rename())
    if since:
        counted = counted.where(F.col("committed_at") >= F.lit(since).cast("timestamp_ntz"))
    rows = lineage.join(counted, "file_id").where("until IS NULL OR committed_at <= until")
    return rows.join(live.select(F.col("id").alias("root"), "path"), "root")


def file_activity(files: DataFrame, changes: DataFrame, since: str | None = None, max_hops: int | None = None) -> DataFrame:
    """file_id, path, commits, churn, binary_changes, last_changed_at of live files with a change."""
    return activity_of(lineage_changes(files, changes, since, max_hops))


def activity_of(rows: DataFrame) -> DataFrame:
    """``file_activity`` of content changes that are at hand already."""
    churn = F.sum(F.when(F.col("additions").isNotNull(), F.col("additions") + F.coalesce("deletions", F.lit(0))).otherwise(0))
    return rows.groupBy(F.col("root").alias("file_id"), "path").agg(
        F.countDistinct("commit_id").alias("commits"),
        churn.cast("bigint").alias("churn"),
        F.count_if(F.col("additions").isNull()).alias("binary_changes"),
        F.max("committed_at").alias("last_changed_at"),
    )


def classify_defects(commits: DataFrame, discussions: DataFrame) -> DataFrame:
    """(commit_id, reason, level, confidence): the strongest reading of each defect-related commit.

    A resolved issue labelled as a bug, a named tracker bug, a revert, or fix wording; a tie goes to
    the earlier rule. All rules are column tests; discussions are reduced before the join.
    """
    bug = F.col("label").rlike(text.BUG_LABEL) & (F.col("type") == "issue")
    labelled = discussions.where(bug & (F.col("relation") == "RESOLVED_BY"))
    labelled = labelled.select("commit_id", F.lit("labelled issue").alias("reason"), F.when(F.col("level") == "INFERRED", "INFERRED").otherwise("DERIVED").alias("level"), F.col("confidence").cast("double").alias("confidence"), F.lit(1).alias("rule"))
    tickets = discussions.where(bug & (F.col("relation") == "REFERENCES") & F.col("provider").isin("jira", "linear"))
    tickets = tickets.select("commit_id", F.lit("bug ticket").alias("reason"), F.lit("INFERRED").alias("level"), F.lit(0.7).alias("confidence"), F.lit(2).alias("rule"))
    subject = F.col("subject")
    kind = (
        F.when(F.concat_ws("\n", subject, "body").rlike(text.REVERT), "revert")
        .when(subject.rlike(text.NOT_A_DEFECT), F.lit(None))
        .when(subject.rlike(text.CONVENTIONAL_FIX), "marked fix")
        .when(subject.rlike(text.FIX_WORDS), "fix wording")
    )
    sure = F.when(F.col("reason") == "revert", 0.7).when(F.col("reason") == "marked fix", 0.6).otherwise(0.5)
    worded = commits.select(F.col("id").alias("commit_id"), kind.alias("reason")).where("reason IS NOT NULL")
    worded = worded.select("commit_id", "reason", F.lit("INFERRED").alias("level"), sure.alias("confidence"), F.lit(3).alias("rule"))
    best = F.max_by(F.struct("reason", "level", "confidence"), F.struct("confidence", -F.col("rule"))).alias("best")
    return labelled.unionByName(tickets).unionByName(worded).groupBy("commit_id").agg(best).select("commit_id", "best.*")


def import_reach(edges: DataFrame, is_test: DataFrame, max_depth: int = REACH_DEPTH) -> DataFrame:
    """(file_id, dependents, tests): files that import a file within ``max_depth`` hops, itself left out.

    Each level joins the last level's new pairs with the edges and drops pairs seen before, so
    cycles end and a pair is made once.
    """
    edges = edges.where("source <> target").select("source", "target").distinct()
    seen = frontier = edges.select(F.col("target").alias("root"), F.col("source").alias("node")).checkpoint()
    step = edges.select(F.col("target").alias("node"), F.col("source").alias("importer"))
    for _ in range(max_depth - 1):
        reached = frontier.join(step, "node").select("root", F.col("importer").alias("node")).where("root <> node").distinct()
        frontier = reached.join(seen, ["root", "node"], "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    tests = is_test.select(F.col("id").alias("node"), "is_test")
    return seen.join(tests, "node", "left").groupBy(F.col("root").alias("file_id")).agg(F.count("*").alias("dependents"), F.count_if(F.coalesce("is_test", F.lit(False))).alias("tests"))


def rankable(include_tests: bool = False, include_generated: bool = False, include_non_code: bool = False) -> Column:
    path = F.col("path")
    keep = F.lit(True)
    if not include_tests:
        keep &= ~paths.is_test(path)
    if not include_generated:
        keep &= ~paths.is_generated(path)
    if not include_non_code:
        keep &= F.coalesce(paths.is_code(path), F.lit(False))
    return keep


def hotspots(files: DataFrame, changes: DataFrame, commits: DataFrame, discussions: DataFrame, imports: DataFrame, coverage: DataFrame | None = None, since: str | None = None, **include: bool) -> DataFrame:
    """Every rankable file with its hotspot and risk scores and their parts.

    score: commits, churn and defects + 1, each against the largest of the ranked files. risk:
    change frequency, import centrality, bug density and missing test reach; a coverage report not
    older than the file's last change replaces the test reach. ``coverage``: file_id, hit, found,
    written_at. The maxima are a one-row aggregate joined back, so no single task sees all files.
    """
    content = lineage_changes(files, changes, since)
    active = activity_of(content).where(rankable(**include))
    defects = classify_defects(commits, discussions).select("commit_id", level_rank(F.col("level")).alias("rank"))
    rows = content.select("root", "commit_id").distinct()
    faults = rows.join(defects, "commit_id").groupBy(F.col("root").alias("file_id")).agg(F.count("*").alias("defects"), F.max("rank").alias("rank"))
    reach = import_reach(imports, files.select("id", paths.is_test(F.col("path")).alias("is_test")))
    table = active.join(faults, "file_id", "left").join(reach, "file_id", "left").fillna(0, ["defects", "dependents", "tests"])
    if coverage is None:
        table = table.withColumns({"hit": F.lit(None).cast("bigint"), "found": F.lit(None).cast("bigint")})
    else:
        table = table.join(coverage, "file_id", "left")
        current = (F.col("found") > 0) & (F.col("written_at") >= F.col("last_changed_at"))
        table = table.withColumns({"hit": F.when(current, F.col("hit")), "found": F.when(current, F.col("found"))})
    most = table.agg(*[F.max(c).alias(f"most_{c}") for c in ("commits", "churn", "defects", "dependents")])
    table = table.crossJoin(F.broadcast(most))

    def against(value: Column, top: str) -> Column:
        return F.when(F.col(top) > 0, value / F.col(top)).otherwise(0.0)

    frequency, churned = against(F.col("commits"), "most_commits"), against(F.col("churn"), "most_churn")
    faulty = (F.col("defects") + 1) / (F.col("most_defects") + 1)
    central, density = against(F.col("dependents"), "most_dependents"), F.col("defects") / F.col("commits")
    untested = F.when(F.col("found").isNotNull(), 1 - F.col("hit") / F.col("found")).otherwise(1 / (1 + F.col("tests")))
    return table.select(
        "file_id", "path", "commits", "churn", "binary_changes", "last_changed_at", "defects", "dependents", "tests",
        round3(frequency * churned * faulty).alias("score"),
        round3(frequency * central * density * untested).alias("risk"),
        round3(untested).alias("test_reach_inverse"),
        F.when(F.col("rank") == 2, "INFERRED").otherwise("DERIVED").alias("level"),
    )


def top_hotspots(table: DataFrame, order_by: str = "score", limit: int = 25) -> DataFrame:
    return table.orderBy(F.desc(order_by), F.desc("commits"), "path").limit(limit)


def fix_histories(symbols: DataFrame, versions: DataFrame, defects: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Symbols with fixes in their history: prior_changes, fixes, level (weakest). ``excluded``: commit ids left out."""
    history = versions.select("symbol_id", "commit_id").distinct()
    if excluded is not None:
        history = history.join(excluded, "commit_id", "left_anti")
    joined = history.join(defects.select("commit_id", level_rank(F.col("level")).alias("rank")), "commit_id", "left")
    counts = joined.groupBy("symbol_id").agg(F.count("*").alias("prior_changes"), F.count("rank").alias("fixes"), level_name(F.max("rank")).alias("level"))
    return symbols.join(counts.where("fixes > 0").withColumnRenamed("symbol_id", "id"), "id")
