"""Who is who, who owns what: identities, ownership, truck factor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.levels import round3

ACTIVE_DAYS = 365
KNOWLEDGE, CONCENTRATION = 0.25, 0.75


def identities(commits: DataFrame, max_rounds: int = 30) -> DataFrame:
    """(name_key, person_key): names joined by shared e-mail addresses; person_key is the least name.

    Names and addresses make a bipartite graph; the least name spreads along it until a round
    changes nothing. Only distinct (name, address) pairs move, not commits.
    """
    pairs = commits.select(text.name_key(F.col("author_name")).alias("name_key"), F.when(~text.is_anonymous(F.col("author_email")), F.lower(F.trim("author_email"))).alias("email")).distinct()
    links = pairs.where("email IS NOT NULL").persist()
    labels = pairs.select("name_key", F.col("name_key").alias("person_key")).distinct()
    before = None
    for _ in range(max_rounds):
        by_mail = links.join(labels, "name_key").groupBy("email").agg(F.min("person_key").alias("least"))
        spread = links.join(by_mail, "email").groupBy("name_key").agg(F.min("least").alias("least"))
        # A label's own label: paths are halved in each round.
        labels = labels.join(spread, "name_key", "left").select("name_key", F.least("person_key", "least").alias("person_key"))
        up = labels.select(F.col("name_key").alias("person_key"), F.col("person_key").alias("up"))
        labels = labels.join(up, "person_key", "left").select("name_key", F.coalesce("up", "person_key").alias("person_key")).checkpoint()
        mark = labels.agg(F.sum(F.xxhash64("name_key", "person_key").cast("decimal(38,0)"))).first()[0]
        if mark == before:
            break
        before = mark
    links.unpersist()
    return labels


def people(commits: DataFrame, names: DataFrame, active_days: int = ACTIVE_DAYS) -> DataFrame:
    """(person_key, person, commits, last_commit_at, active): shown under the name of the latest commit."""
    known = commits.withColumn("name_key", text.name_key(F.col("author_name"))).join(names, "name_key")
    summed = known.groupBy("person_key").agg(
        F.max_by("author_name", F.struct("committed_at", -F.col("id"))).alias("person"), F.count("*").alias("commits"), F.max("committed_at").alias("last_commit_at")
    )
    as_of = commits.agg(F.max("committed_at").alias("as_of"))
    active = F.col("last_commit_at") >= F.col("as_of") - F.make_dt_interval(F.lit(active_days))
    return summed.crossJoin(F.broadcast(as_of)).withColumn("active", active).drop("as_of")


def ownership(rows: DataFrame, commits: DataFrame, names: DataFrame, persons: DataFrame) -> DataFrame:
    """(file_id, path, person_key, person, commits, churn, share, place, at_risk) for each file and person.

    ``rows``: content changes by file (root, path, commit_id, additions, deletions). Shares are of
    lines, or of commits where no line was counted.
    """
    lines = F.coalesce(F.col("additions") + F.coalesce("deletions", F.lit(0)), F.lit(0))
    authors = commits.select(F.col("id").alias("commit_id"), text.name_key(F.col("author_name")).alias("name_key")).join(names, "name_key").select("commit_id", "person_key")
    by_commit = rows.groupBy("root", "path", "commit_id").agg(F.sum(lines).alias("lines")).join(authors, "commit_id")
    by_person = by_commit.groupBy(F.col("root").alias("file_id"), "path", "person_key").agg(F.count("*").alias("commits"), F.sum("lines").cast("bigint").alias("churn"))
    by_person = by_person.join(persons.select("person_key", "person", "active"), "person_key")
    whole = Window.partitionBy("file_id")
    share = F.when(F.sum("churn").over(whole) > 0, F.col("churn") / F.sum("churn").over(whole)).otherwise(F.col("commits") / F.sum("commits").over(whole))
    ranked = by_person.withColumn("share", round3(share))
    ranked = ranked.withColumn("place", F.row_number().over(whole.orderBy(F.desc("share"), F.desc("commits"), "person", "person_key")))
    return ranked.withColumn("at_risk", (F.col("place") == 1) & (F.col("share") >= CONCENTRATION) & ~F.col("active"))


def truck_factor(owned: DataFrame) -> DataFrame:
    """(place, person): people whose leaving, most knowing first, leaves over half of the files without anyone who knows them.

    How many files a person knows doesn't change when others leave, so the greedy order is the order
    by that number, and a file is lost with the last of its people. So no loop is needed: the answer
    is the place at which the lost files pass the half.
    """
    knowers = owned.where((F.col("place") == 1) | (F.col("share") >= KNOWLEDGE)).select("file_id", "person").distinct().checkpoint()
    # One row a person is numbered, and one row a place summed up.
    ranks = knowers.groupBy("person").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "person"))).select("person", "place")
    lost = knowers.join(ranks, "person").groupBy("file_id").agg(F.max("place").alias("at")).groupBy("at").agg(F.count("*").alias("n"))
    upto = lost.withColumn("orphaned", F.sum("n").over(Window.orderBy("at")))
    files = lost.agg(F.sum("n").alias("files"))
    last = upto.crossJoin(F.broadcast(files)).where("orphaned * 2 > files").agg(F.min("at").alias("last"))
    return ranks.crossJoin(F.broadcast(last)).where("place <= last").select("place", "person")
