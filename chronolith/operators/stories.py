"""Vertex labels, file summaries, saved answers, question kinds, snapshot refresh and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import graph

# What a question asks for, tried in this order.
QUESTION_KINDS = {
    "impact": r"(?i)\b(?:what|who|which)\b.*\b(?:depends?|uses?|imports?|breaks?|affected)\b|\bimpact of\b|\bwhat breaks\b",
    "timeline": r"(?i)\b(?:history|timeline|evolution) of\b|\bwhat changed in\b|\bhow (?:did|has)\b.*\bchange|\bwhen (?:was|were|did)\b.*\bchang",
    "why": r"(?i)\bwhy\b|\bwhat is .* for\b|\breason for\b|\bpurpose of\b",
}


def question_kind(question: Column) -> Column:
    """impact, timeline or why; null for a question that has no deterministic answer."""
    found = F.when(F.lit(False), "")
    for kind, pattern in QUESTION_KINDS.items():
        found = found.when(question.rlike(pattern), kind)
    return found


def vertices(commits: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(key, label) of every commit, file and symbol."""
    one = lambda df, kind, label: df.select(graph.key(F.lit(kind), F.col("id")).alias("key"), label.alias("label"))
    named = F.concat_ws(" ", "kind", "qualified_name")
    return one(commits, "commit", F.concat_ws(" ", F.substring("sha", 1, 7), "subject")).unionByName(one(files, "file", F.col("path"))).unionByName(one(symbols, "symbol", named))


def labelled(keys: DataFrame, vertex: DataFrame) -> DataFrame:
    """``keys`` (key) with label; what doesn't exist is said to be missing."""
    return keys.join(vertex, "key", "left").withColumn("label", F.coalesce("label", F.concat(F.col("key"), F.lit(" (missing)"))))


def lens_title(changes: Column, authors: Column, fixes: Column, callers: Column) -> Column:
    """One line about a symbol; parts with nothing to say are left out."""
    def part(n: Column, one: str, many: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}")))

    return F.concat_ws(" · ", part(changes, "change", "changes"), part(authors, "author", "authors"), part(fixes, "fix", "fixes"), part(callers, "caller", "callers"))


def changed_snapshot(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths to parse again: rows (path, digest) of ``after`` that ``before`` lacks or has otherwise."""
    return after.join(before, ["path", "digest"], "left_anti")


def parse_once(blobs: DataFrame) -> DataFrame:
    """(digest, path): each content once, so that copies are parsed one time; ``blobs``: path, content."""
    return blobs.groupBy(F.sha2("content", 256).alias("digest")).agg(F.min("path").alias("path"))


def save_investigation(answers: DataFrame, path: str) -> None:
    """Appends answers (question, kind, answer, confidence, level, asked_at) to the saved ones."""
    answers.withColumn("result", F.to_json(F.struct(*answers.columns))).write.mode("append").parquet(path)


def saved_investigations(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("asked_at"), "question").limit(limit)


def export_graph(nodes: DataFrame, links: DataFrame, path: str) -> None:
    """Nodes and links as JSON lines under ``path``; one document a line, written in parallel."""
    nodes.select(F.lit("node").alias("type"), F.to_json(F.struct("*")).alias("data")).unionByName(links.select(F.lit("link").alias("type"), F.to_json(F.struct("*")).alias("data"))).write.json(path)


def keywords(question: Column, limit: int = 8) -> Column:
    """Distinct longer words of a question, longest first."""
    words = F.array_distinct(F.filter(F.split(F.lower(question), r"[^\p{L}0-9_./]+"), lambda w: F.length(w) >= 4))
    ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.slice(F.transform(ranked, lambda s: s["w"]), 1, limit)


def grounding(questions: DataFrame, entities: DataFrame, most: int = 3, targets: int = 4) -> DataFrame:
    """(question_id, word, key): entities (key, word) that a question's keywords name, up to ``targets`` of each.

    A word that names more than ``most`` entities says nothing and is skipped, before it can make rows.
    """
    from pyspark.sql import Window

    rare = entities.groupBy("word").agg(F.count("*").alias("n"), F.collect_list("key").alias("keys")).where(F.col("n") <= most)
    asked = questions.select("question_id", F.posexplode(keywords(F.col("text"))).alias("place", "word"))
    found = asked.join(rare, "word").select("question_id", "word", "place", F.explode("keys").alias("key"))
    n = F.row_number().over(Window.partitionBy("question_id").orderBy("place", "key"))
    return found.withColumn("n", n).where(F.col("n") <= targets).select("question_id", "word", "key")


def owners_sentence(owned: DataFrame) -> DataFrame:
    """(file_id, sentence): how many people wrote a file and who most of it."""
    top = owned.groupBy("file_id").agg(F.count("*").alias("people"), F.min_by(F.struct("person", "share"), "place").alias("top"))
    many = F.when(F.col("people") == 1, F.concat(F.lit("1 person, "), F.col("top.person"))).otherwise(F.concat(F.col("people").cast("string"), F.lit(" people, most by "), F.col("top.person")))
    return top.select("file_id", many.alias("sentence"))


def gitlab_references(message: Column) -> tuple[Column, Column]:
    """Numbers of issues (#n) and merge requests (!n) that a message names."""
    issues = F.regexp_extract_all(message, F.lit(r"(?:^|[^\w/&#!.-])#(\d+)\b"), F.lit(1))
    requests = F.regexp_extract_all(message, F.lit(r"(?:^|[^\w/&#!.-])!(\d+)\b"), F.lit(1))
    return F.array_distinct(issues), F.array_distinct(requests)


def python_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[-_.]+", "_")


def day_counts(commits: DataFrame) -> DataFrame:
    return commits.groupBy(text.day(F.col("committed_at")).alias("day")).agg(F.count("*").alias("commits"))
