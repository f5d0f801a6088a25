"""Why something exists: statements from the evidence, each with its level, confidence and citations, for all targets at once.

A statement frame has key (the target), step and place (its order in the answer), text, role, level,
confidence and cited (array of evidence names). What the evidence doesn't say is stated as absent
and never guessed. An answer is as sure as its least sure statement and as strong as its weakest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.levels import level_rank, weakest
from ..functions.stored import settled, written
from . import activity, graph, people

#: Longest chain of copies that is followed.
COPY_HOPS = 10
NO_ORIGIN = "The indexed history does not show where it was introduced: it predates the indexed history or was added in a merge commit."

COLUMNS = ["key", "step", "place", "text", "role", "level", "confidence", "cited"]


def statement(rows: DataFrame, key: Column, step: int, text_: Column, role: Column | str, level: Column | str, confidence: Column | float, cited: Column | None = None, place: Column | None = None) -> DataFrame:
    """Statements of one kind, a row each; ``place`` orders those of one step."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        key.alias("key"), F.lit(step).alias("step"), (F.lit("") if place is None else place).alias("place"), text_.alias("text"), as_column(role).alias("role"),
        as_column(level).alias("level"), as_column(confidence).cast("double").alias("confidence"), (F.array().cast("array<string>") if cited is None else cited).alias("cited"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def described(commits: DataFrame) -> DataFrame:
    """commit_id, commit_text, commit_evidence, committed_at and body of each commit."""
    words = F.concat(F.lit("commit "), F.substring("sha", 1, 7), F.lit(' "'), F.col("subject"), F.lit('" by '), F.col("author_name"), F.lit(" on "), text.day(F.col("committed_at")))
    return commits.select(F.col("id").alias("commit_id"), words.alias("commit_text"), F.concat(F.lit("commit:"), F.col("sha")).alias("commit_evidence"), "committed_at", "body")


def relation_evidence(id_: Column) -> Column:
    return F.concat(F.lit("relation:"), id_.cast("string"))


def links_of(relations: DataFrame, relation: str, source: str, target: str) -> DataFrame:
    """source_id, target_id, link (its evidence), level and c (confidence) of one kind of relation."""
    rows = relations.where((F.col("relation") == relation) & (F.col("source_type") == source) & (F.col("target_type") == target))
    return rows.select("source_id", "target_id", relation_evidence(F.col("id")).alias("link"), "level", F.col("confidence").cast("double").alias("c"))


def resolution_basis(confidence: Column) -> Column:
    """How a resolution is known."""
    return F.when(confidence >= 1, "recorded").when(confidence >= 0.9, "closing reference").otherwise("mentioned")


def context(relations: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What explains a commit: statements keyed by commit_id with a confidence of their own (to be multiplied by
    that of the chain that leads to the commit), and related (commit_id, related)."""
    paragraph = text.first_paragraph(F.col("body"))
    messages = described(commits).where(F.length(paragraph) > 0)
    found = [statement(messages, F.col("commit_id"), 1, F.concat(F.lit('Its commit message explains: "'), paragraph, F.lit('"')), "commit message", "FACT", 1.0, F.array("commit_evidence"))]
    carried = links_of(relations, "IMPLEMENTED_BY", "pull_request", "commit")
    request = F.concat(F.lit("pull request #"), F.col("source_id").cast("string"))
    found.append(statement(carried, F.col("target_id"), 2, F.concat(F.lit("It is part of "), request, F.lit(".")), "pull request carrying the change", F.col("level"), F.col("c"), F.array("link"), F.col("link")))
    closes = links_of(relations, "RESOLVED_BY", "issue", "pull_request").select(F.col("source_id").alias("issue"), F.col("target_id").alias("source_id"), F.col("link").alias("its_link"), F.col("level").alias("its_level"), F.col("c").alias("its_c"))
    through = carried.join(closes, "source_id")
    resolves = lambda who, issue, c: F.concat(who, F.lit(" resolves issue #"), issue.cast("string"), F.lit(" ("), resolution_basis(c), F.lit(")."))
    found.append(statement(through, F.col("target_id"), 2, resolves(F.concat(F.lit("P"), F.substring(request, 2, 100)), F.col("issue"), F.col("its_c")), "resolved issue", F.col("its_level"), F.col("c") * F.col("its_c"), F.array("its_link"), F.concat_ws("/", "link", "its_link")))
    own = links_of(relations, "RESOLVED_BY", "issue", "commit")
    found.append(statement(own, F.col("target_id"), 3, resolves(F.lit("The commit itself"), F.col("source_id"), F.col("c")), "resolved issue", F.col("level"), F.col("c"), F.array("link"), F.col("link")))
    mentions = relations.where("relation = 'REFERENCES' AND source_type IN ('commit', 'pull_request')").select("source_type", "source_id", graph.key(F.col("target_type"), F.col("target_id")).alias("related"))
    by_commit = mentions.where("source_type = 'commit'").select(F.col("source_id").alias("commit_id"), "related")
    by_request = carried.join(mentions.where("source_type = 'pull_request'"), "source_id").select(F.col("target_id").alias("commit_id"), "related")
    return union(found).withColumnRenamed("key", "commit_id"), by_commit.unionByName(by_request).distinct()


def in_context(targets: DataFrame, statements: DataFrame, step: int) -> DataFrame:
    """The commits' statements for targets (key, commit_id, base): chains multiply."""
    return targets.select("key", "commit_id", "base").join(statements, "commit_id").select("key", (F.col("step") + step).alias("step"), "place", "text", "role", "level", (F.col("base") * F.col("confidence")).alias("confidence"), "cited")


def conclude(statements: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """key, answer, confidence, level, statements (their number), evidence (struct of name and reasons, by name) and related (sorted keys).

    ``related``: key, related. Evidence that several statements rest on is cited once, for all their roles.
    Statements are made and shuffled once: the answer and its evidence come from the same group.
    """
    said = F.collect_list(F.struct("step", "place", "text"))
    cited = F.flatten(F.collect_list(F.transform("cited", lambda name: F.struct(name.alias("name"), F.col("role").alias("role")))))
    groups = statements.repartition("key").groupBy("key").agg(said.alias("said"), F.min("confidence").alias("confidence"), weakest(F.col("level")).alias("level"), F.count("*").alias("statements"), cited.alias("cited"))
    # Sorted, equal pairs lie side by side; array_distinct would hold each pair of structs against all others.
    pairs = groups.withColumn("cited", F.sort_array("cited")).withColumn("cited", F.expr("filter(cited, (c, i) -> i = 0 OR NOT (c <=> cited[i - 1]))"))
    # Where the next name begins among the sorted pairs; a name's roles are the slice up to there.
    begins = pairs.withColumn("begins", F.expr("filter(transform(cited, (c, i) -> IF(i = 0 OR c.name <> cited[i - 1].name, i, -1)), i -> i >= 0)"))
    evidence = F.expr("transform(begins, (b, k) -> struct(cited[b].name AS name, array_join(transform(slice(cited, b + 1, coalesce(get(begins, k + 1), size(cited)) - b), c -> c.role), '; ') AS reasons))")
    answer = F.array_join(F.transform(F.sort_array("said"), lambda s: s["text"]), " ")
    out = begins.select("key", answer.alias("answer"), "confidence", "level", "statements", F.when(F.size("cited") > 0, evidence).alias("evidence"))
    if related is None:
        return out.withColumn("related", F.array().cast("array<string>"))
    return out.join(related.groupBy("key").agg(F.array_sort(F.collect_set("related")).alias("related")), "key", "left")


def later_changes(rows: DataFrame, targets: DataFrame, commit: DataFrame, step: int, level: str) -> DataFrame:
    """How often each of ``targets`` (key) changed after it appeared; ``rows``: key, commit_id."""
    dated = rows.join(commit.select("commit_id", "commit_text", "commit_evidence", "committed_at"), "commit_id")
    latest = dated.groupBy("key").agg(F.count("*").alias("n"), F.max_by(F.struct("commit_text", "commit_evidence"), F.struct("committed_at", "commit_id")).alias("last"))
    all_ = targets.select("key").distinct().join(latest, "key", "left")
    said = F.when(F.col("n").isNull(), "It has not changed since.").otherwise(F.concat(F.lit("It changed "), counted(F.col("n"), "time", "times"), F.lit(" since, most recently in "), F.col("last.commit_text"), F.lit(".")))
    cited = F.when(F.col("n").isNull(), F.array().cast("array<string>")).otherwise(F.array("last.commit_evidence"))
    return statement(all_, F.col("key"), step, said, "later changes", level, 1.0, cited)


def copy_hops(copies: DataFrame, max_hops: int = COPY_HOPS) -> DataFrame:
    """(key, hop, at, source_id, link, level, c, method): the copies that lead from each symbol back to code that wasn't copied.

    ``copies``: source_id (the copy), target_id, link, level, c, method; of several the first by link
    is followed. A chain ends where it would come back to itself.
    """
    one = copies.groupBy("source_id").agg(F.min_by(F.struct("target_id", "link", "level", "c", "method"), "link").alias("to"))
    step = one.select(F.col("source_id").alias("at"), "to.*")
    frontier = one.select(F.col("source_id").alias("key"), F.col("source_id").alias("at"), F.array("source_id").alias("seen"))
    hops = []
    for hop in range(max_hops):
        taken = frontier.join(step, "at").where("NOT array_contains(seen, target_id)").select("key", F.lit(hop).alias("hop"), "at", F.col("target_id").alias("source_id"), "link", "level", "c", "method", "seen").checkpoint()
        if taken.isEmpty():
            break
        hops.append(taken.drop("seen"))
        frontier = taken.select("key", F.col("source_id").alias("at"), F.concat("seen", F.array("source_id")).alias("seen"))
    return union(hops) if hops else frontier.join(step, "at").limit(0).select("key", F.lit(0).alias("hop"), "at", F.col("target_id").alias("source_id"), "link", "level", "c", "method")


def symbols_why(symbols: DataFrame, files: DataFrame, versions: DataFrame, relations: DataFrame, commits: DataFrame, covered: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Answers for every symbol (key: its id).

    ``versions``: symbol_id, commit_id; ``covered``: key, found, hit (instrumented lines of current
    symbols, and those that ran); ``known``: the name and person tables of ``people``, if at hand.
    Steps: definition, coverage, copies back to the original, introducing commit with its message,
    pull requests and issues, later changes, authors.
    """
    commit = written(described(commits))
    changed = written(versions.select(F.col("symbol_id").alias("key"), "commit_id").distinct())
    place = settled(symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("id").alias("key"), F.concat_ws(" ", "kind", "qualified_name").alias("named"), "path", "start_line", "end_line", "current"))
    contained = relations.where("relation = 'CONTAINS' AND target_type = 'symbol'").groupBy(F.col("target_id").alias("key")).agg(F.array(F.min(relation_evidence(F.col("id")))).alias("holds"))
    lines = F.concat(F.lit(" at lines "), F.col("start_line").cast("string"), F.lit("–"), F.col("end_line").cast("string"), F.lit("."))
    defined = F.when(F.col("current"), F.concat("named", F.lit(" is defined in "), "path", lines)).otherwise(F.concat("named", F.lit(" no longer exists at HEAD; it was last seen in "), "path", F.lit(".")))
    parts = [settled(statement(place.join(contained, "key", "left"), F.col("key"), 0, defined, "definition", "FACT", 1.0, F.coalesce("holds", F.array().cast("array<string>"))))]
    ran = covered.where("found > 0").join(place.where("current").select("key"), "key", "left_semi")
    parts.append(settled(statement(ran, F.col("key"), 1, F.concat(F.col("hit").cast("string"), F.lit(" of its "), F.col("found").cast("string"), F.lit(" instrumented lines ran in the tests.")), "line coverage", "DERIVED", 1.0)))

    first = settled(changed.join(commit.select("commit_id", "committed_at"), "commit_id").groupBy("key").agg(F.min_by("commit_id", F.struct("committed_at", "commit_id")).alias("commit_id")))
    copies = links_of(relations, "COPIED_FROM", "symbol", "symbol")
    if "method" in relations.columns:
        copies = copies.join(relations.select(relation_evidence(F.col("id")).alias("link"), "method"), "link")
    else:
        copies = copies.withColumn("method", F.lit("identical-content"))
    copies = copies.join(symbols.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    hops = settled(copy_hops(copies))
    source = place.select(F.col("key").alias("source_id"), F.concat("named", F.lit(" in "), "path").alias("origin_text"))
    when = first.withColumnRenamed("key", "at").join(commit.select("commit_id", "commit_text", "commit_evidence"), "commit_id").drop("commit_id")
    copied = hops.join(source, "source_id").join(when, "at", "left")
    subject = F.when(F.col("hop") == 0, "It").otherwise("That")
    when_text = F.coalesce(F.concat(F.lit(" in "), "commit_text"), F.lit(""))
    moved, renamed = F.col("method") == "moved-with-edits", F.col("method") == "renamed"
    copied_text = (
        F.when(renamed, F.concat(subject, F.lit(" was renamed from "), "origin_text", when_text, F.lit("; the code is otherwise identical.")))
        .when(moved, F.concat(subject, F.lit(" looks moved, with edits, from "), "origin_text", when_text, F.lit(": that definition left its file in the same commit (inferred from the name, not the content).")))
        .otherwise(F.concat(subject, F.lit(" was copied, with identical content, from "), "origin_text", when_text, F.lit(".")))
    )
    role = F.when(renamed, "renamed from").when(moved, "moved from").otherwise("copied from")
    parts.append(settled(statement(copied, F.col("key"), 2, copied_text, role, F.col("level"), F.col("c"), F.array_compact(F.array("link", "commit_evidence")), F.lpad(F.col("hop").cast("string"), 2, "0"))))

    ends = hops.groupBy("key").agg(F.max_by("source_id", "hop").alias("origin"), F.min_by("at", "hop").alias("copy"))
    born = links_of(relations, "INTRODUCED_BY", "symbol", "commit").join(commit.select(F.col("commit_id").alias("target_id")), "target_id", "left_semi")
    born = born.groupBy(F.col("source_id").alias("origin")).agg(F.min_by(F.struct(F.col("target_id").alias("commit_id"), "link", "level", "c"), "link").alias("b")).select("origin", "b.*")
    traced = place.select("key").join(ends, "key", "left").withColumn("origin_of", F.coalesce("origin", "key"))
    with_birth = settled(traced.join(born.withColumnRenamed("origin", "origin_of"), "origin_of", "left").join(commit.select("commit_id", "commit_text", "commit_evidence"), "commit_id", "left"))
    known_birth, unknown = with_birth.where("commit_id IS NOT NULL"), with_birth.where("commit_id IS NULL")
    introduced = F.concat(F.when(F.col("origin").isNotNull(), "That code").otherwise("It"), F.lit(" was introduced in "), "commit_text", F.lit("."))
    parts.append(settled(statement(known_birth, F.col("key"), 3, introduced, "introducing commit", F.col("level"), F.col("c"), F.array("link", "commit_evidence"))))
    parts.append(settled(statement(unknown, F.col("key"), 3, F.lit(NO_ORIGIN), "absence of origin evidence", "FACT", 1.0)))
    explained, related = context(relations, commits)
    parts.append(settled(in_context(known_birth.select("key", "commit_id", F.col("c").alias("base")), explained, 3)))
    mentioned = settled(known_birth.select("key", "commit_id").join(related, "commit_id").select("key", "related"))

    # For a copy the commit that made it, else the one that introduced it, isn't a later change.
    made = with_birth.where("origin IS NOT NULL").select("key").join(first, "key").select("key", "commit_id")
    made = made.unionByName(known_birth.join(made.select("key"), "key", "left_anti").select("key", "commit_id"))
    parts.append(settled(later_changes(changed.join(made, ["key", "commit_id"], "left_anti"), place, commit, 7, "DERIVED")))
    parts.append(settled(authors(changed, commits, commit, known)))
    return conclude(union(parts), mentioned)


def authors(changed: DataFrame, commits: DataFrame, commit: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Who made the commits of each key, under all their names, and whether the first among them is still active."""
    names = known[0] if known else people.identities(commits)
    persons = known[1] if known else people.people(commits, names)
    who = commits.select(F.col("id").alias("commit_id"), text.name_key(F.col("author_name")).alias("name_key"), "committed_at").join(names, "name_key").join(persons.select("person_key", "person", "last_commit_at", "active"), "person_key")
    by_person = changed.join(who, "commit_id").groupBy("key", "person_key", "person", "active", "last_commit_at").agg(F.count("*").alias("n"), F.max_by("commit_id", F.struct("committed_at", "commit_id")).alias("commit_id"))
    summed = by_person.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("people"), F.max("n").alias("most"))
    # Of several with as many commits the first by name.
    top = by_person.join(summed, "key").where("n = most").groupBy("key", "total", "people").agg(F.min_by(F.struct("person", "n", "active", "last_commit_at", "commit_id"), F.struct("person", "person_key")).alias("p")).select("key", "total", "people", "p.*")
    top = top.join(commit.select("commit_id", "commit_evidence"), "commit_id")
    last = F.concat(F.lit(" (last on "), text.day(F.col("last_commit_at")), F.lit(")."))
    lasting = F.when(F.col("active"), F.concat(F.lit(" "), "person", F.lit(" still commits to the repository"), last)).otherwise(F.concat(F.lit(" "), "person", F.lit(" has not committed in the year before the latest commit"), last))
    said = F.concat(F.lit("Its "), counted(F.col("total"), "commit was", "commits were"), F.lit(" made by "), counted(F.col("people"), "person", "people"), F.lit(", most by "), "person", F.lit(" ("), F.col("n").cast("string"), F.lit(")."), lasting)
    return statement(top, F.col("key"), 8, said, "authors", "DERIVED", 1.0, F.array("commit_evidence"))


def files_why(files: DataFrame, changes: DataFrame, relations: DataFrame, commits: DataFrame) -> DataFrame:
    """Answers for every file (key: its id): state, creation across renames, renames, later changes.

    ``changes``: id, commit_id, file_id, status, previous_file_id, additions, deletions, committed_at.
    A rename without changed lines is told as a rename and isn't counted as a change.
    """
    commit = described(commits).checkpoint()
    paths = files.select(F.col("id").alias("at_file"), F.col("path").alias("at_path"))
    state = F.concat("path", F.when(F.col("deleted"), F.lit(" was deleted.")).otherwise(F.lit(" exists at HEAD.")))
    parts = [statement(files, F.col("id"), 0, state, "current state", "FACT", 1.0)]
    lineage = activity.rename_lineage(files, changes).join(paths, F.col("file_id") == F.col("at_file")).drop("at_file")
    entries = lineage.join(changes.withColumnRenamed("id", "change_id"), "file_id").where("until IS NULL OR committed_at <= until").withColumnRenamed("root", "key").checkpoint()
    order = F.struct("committed_at", "commit_id", "change_id")
    first = entries.groupBy("key").agg(F.min_by(F.struct("change_id", "commit_id", "status", "at_path"), order).alias("f")).select("key", "f.*")
    created = first.where("status = 'added'").join(files.select(F.col("id").alias("key"), "path"), "key").join(commit.select("commit_id", "commit_text", "commit_evidence"), "commit_id")
    once = F.when(F.col("at_path") == F.col("path"), F.lit("")).otherwise(F.concat(F.lit(" as "), "at_path"))
    parts.append(statement(created, F.col("key"), 1, F.concat(F.lit("It was created"), once, F.lit(" in "), "commit_text", F.lit(".")), "creating commit", "FACT", 1.0, F.array("commit_evidence")))
    parts.append(statement(files.select(F.col("id").alias("key")).join(created.select("key"), "key", "left_anti"), F.col("key"), 1, F.lit(NO_ORIGIN), "absence of origin evidence", "FACT", 1.0))
    explained, related = context(relations, commits)
    parts.append(in_context(created.select("key", "commit_id", F.lit(1.0).alias("base")), explained, 1))
    later = entries.join(first.select("key", "change_id"), ["key", "change_id"], "left_anti")
    old = paths.select(F.col("at_file").alias("previous_file_id"), F.col("at_path").alias("old_path"))
    renamed = later.where("status = 'renamed'").join(old, "previous_file_id", "left").join(commit.select("commit_id", "commit_text", "commit_evidence"), "commit_id")
    said = F.concat(F.lit("It was renamed from "), F.coalesce("old_path", F.lit("?")), F.lit(" to "), "at_path", F.lit(" in "), "commit_text", F.lit("."))
    parts.append(statement(renamed, F.col("key"), 5, said, "rename", "FACT", 1.0, F.array("commit_evidence"), F.concat(F.date_format("committed_at", "yyyyMMddHHmmss"), F.lpad(F.col("change_id").cast("string"), 20, "0"))))
    parts.append(later_changes(later.where(~activity.is_pure_rename(1)).select("key", "commit_id"), files.select(F.col("id").alias("key")), commit, 6, "FACT"))
    return conclude(union(parts), created.select("key", "commit_id").join(related, "commit_id").select("key", "related"))


def commits_why(relations: DataFrame, commits: DataFrame) -> DataFrame:
    """Answers for every commit (key: its id)."""
    commit = described(commits)
    explained, related = context(relations, commits)
    parts = [statement(commit, F.col("commit_id"), 0, F.concat(F.lit("This is "), "commit_text", F.lit(".")), "the commit", "FACT", 1.0, F.array("commit_evidence"))]
    parts.append(in_context(commits.select(F.col("id").alias("key"), F.col("id").alias("commit_id"), F.lit(1.0).alias("base")), explained, 1))
    return conclude(union(parts), related.withColumnRenamed("commit_id", "key"))


def work_why(relations: DataFrame, commits: DataFrame) -> DataFrame:
    """Answers for every issue and pull request that a relation names (key: type and id)."""
    ends = relations.select(F.col("source_type").alias("type"), F.col("source_id").alias("id")).unionByName(relations.select(F.col("target_type").alias("type"), F.col("target_id").alias("id"))).where("type IN ('issue', 'pull_request')").distinct()
    key, name = graph.key(F.col("type"), F.col("id")), F.concat(F.when(F.col("type") == "issue", "Issue #").otherwise("Pull request #"), F.col("id").cast("string"))
    parts = [statement(ends, key, 0, F.concat(name, F.lit(" is known.")), F.when(F.col("type") == "issue", "the issue").otherwise("the pull request"), "FACT", 1.0)]
    commit = described(commits).select(F.col("commit_id").alias("target_id"), "commit_text")
    resolved = links_of(relations, "RESOLVED_BY", "issue", "commit").join(commit, "target_id")
    parts.append(statement(resolved, graph.key(F.lit("issue"), F.col("source_id")), 1, F.concat(F.lit("It is resolved by "), "commit_text", F.lit(" ("), resolution_basis(F.col("c")), F.lit(").")), "resolution", F.col("level"), F.col("c"), F.array("link"), F.col("link")))
    carried = links_of(relations, "IMPLEMENTED_BY", "pull_request", "commit").join(commit, "target_id")
    listed = F.array_sort(F.collect_list(F.struct("link", "commit_text")))
    summed = carried.groupBy("source_id").agg(F.count("*").alias("n"), F.min("c").alias("c"), F.max(level_rank(F.col("level"))).alias("r"), listed.alias("rows"))
    summed = summed.withColumn("level", F.element_at(F.array(*map(F.lit, ("FACT", "DERIVED", "INFERRED"))), F.col("r") + 1))
    named = F.array_join(F.transform("rows", lambda r: r["commit_text"]), "; ")
    parts.append(statement(summed, graph.key(F.lit("pull_request"), F.col("source_id")), 2, F.concat(F.lit("It is implemented by "), counted(F.col("n"), "indexed commit", "indexed commits"), F.lit(": "), named, F.lit(".")), "implementing commits", F.col("level"), F.col("c"), F.transform("rows", lambda r: r["link"])))
    closed = links_of(relations, "RESOLVED_BY", "issue", "pull_request")
    parts.append(statement(closed, graph.key(F.lit("pull_request"), F.col("target_id")), 3, F.concat(F.lit("It resolves issue #"), F.col("source_id").cast("string"), F.lit(" ("), resolution_basis(F.col("c")), F.lit(").")), "resolved issue", F.col("level"), F.col("c"), F.array("link"), F.col("link")))
    mentions = relations.where("relation = 'REFERENCES' AND target_type IN ('issue', 'pull_request')").select(graph.key(F.col("target_type"), F.col("target_id")).alias("key"), graph.key(F.col("source_type"), F.col("source_id")).alias("related"))
    return conclude(union(parts), mentions)
