"""Readers of what a repository holds: commit log records, coverage reports, manifests.

Each takes text that is landed in files (or rows) and gives the canonical columns, with Spark doing
the splitting; nothing is run on the driver but the choice of paths.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``git log --topo-order --reverse -M --raw --numstat -z --format=...`` with these separators.
RECORD, FIELD = "\x1e", "\x1f"
LOG_FORMAT = f"%x1e{'%x1f'.join(('%H', '%P', '%an', '%ae', '%aI', '%cn', '%cI', '%s', '%b'))}%x1f"
# Status letters of raw records; a copy adds a file and a type change modifies one.
STATUS = {"A": "added", "C": "added", "M": "modified", "T": "modified", "D": "deleted", "R": "renamed"}


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(raw) one row a commit record of landed log output; records never straddle rows."""
    return spark.read.option("lineSep", RECORD).text(path).withColumnRenamed("value", "raw").where("length(trim(raw)) > 0")


def parse_commits(records: DataFrame) -> DataFrame:
    """sha, parents, author_name, author_email, committed_at, subject, body and changes of each record.

    changes: array of (status, path, previous_path, additions, deletions); counts are null for
    binary files, and a merge has no changes.
    """
    parts = F.split("raw", FIELD)
    time_of = F.to_timestamp(parts[6])
    table = records.select(
        parts[0].alias("sha"), F.filter(F.split(parts[1], " "), lambda p: p != "").alias("parents"), parts[2].alias("author_name"), parts[3].alias("author_email"),
        time_of.alias("committed_at"), parts[7].alias("subject"), F.trim(parts[8]).alias("body"), _changes(parts[9]).alias("changes"),
    )
    return table.withColumn("changes", F.when(F.size("parents") > 1, F.array().cast(table.schema["changes"].dataType)).otherwise(F.col("changes")))


def _changes(tail: Column) -> Column:
    # Raw entries (":modes shas X\0path\0[new path\0]"), then counts ("add\tdel\tpath\0", renames with two more paths).
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    entry = r":[0-7]{6} [0-7]{6} [0-9a-f]+ [0-9a-f]+ (?:([RC])[0-9]*\x00([^\x00]*)\x00([^\x00]*)\x00|([A-Z])[0-9]*\x00([^\x00]*)\x00)"
    moved, old, new, letter, path = (F.regexp_extract_all(tail, F.lit(entry), F.lit(g)) for g in range(1, 6))
    counts = r"(?:^|[\x00\n])([0-9]+|-)\t([0-9]+|-)\t"
    added, gone = (F.regexp_extract_all(tail, F.lit(counts), F.lit(g)) for g in (1, 2))
    rows = F.arrays_zip(moved.alias("r"), old.alias("old"), new.alias("new"), letter.alias("s"), path.alias("path"), added.alias("p"), gone.alias("m"))

    def row(r: Column) -> Column:
        two = r["r"] != ""
        number = lambda c: F.when(c != "-", c.cast("int"))
        kind = F.when(two, r["r"]).otherwise(r["s"])
        return F.struct(status[kind].alias("status"), F.when(two, r["new"]).otherwise(r["path"]).alias("path"), F.when(r["r"] == "R", r["old"]).alias("previous_path"), number(r["p"]).alias("additions"), number(r["m"]).alias("deletions"))

    return F.transform(rows, row)


def read_coverage(reports: DataFrame) -> DataFrame:
    """(path, found, hit) of lcov reports given as rows (report, content): instrumented and run lines, ascending.

    A file that is reported more than once is merged; lines that aren't whole positive numbers with
    finite counts are skipped.
    """
    section = F.explode(F.split("content", r"(?m)^\s*SF:"))
    rows = reports.select(section.alias("part")).where(F.col("part").rlike(r"(?m)^\s*DA:|end_of_record"))
    body = F.split("part", r"(?m)^\s*end_of_record")[0]
    rows = rows.select(F.trim(F.split("part", "\n")[0]).alias("path"), body.alias("body"))
    da = r"(?m)^\s*DA:([0-9]+),(-?[0-9]+(?:[.][0-9]+)?)"
    numbers = F.arrays_zip(F.regexp_extract_all("body", F.lit(da), F.lit(1)).alias("line"), F.regexp_extract_all("body", F.lit(da), F.lit(2)).alias("hits"))
    lines = rows.select("path", F.explode_outer(numbers).alias("n")).select("path", F.col("n.line").cast("int").alias("line"), (F.col("n.hits").cast("double") > 0).alias("ran")).where("line IS NULL OR line >= 1")
    merged = lines.groupBy("path", "line").agg(F.bool_or("ran").alias("ran"))
    return merged.groupBy("path").agg(F.array_sort(F.collect_set("line")).alias("found"), F.array_sort(F.collect_set(F.when(F.col("ran"), F.col("line")))).alias("hit"))


MANIFESTS = {"package.json": "npm", "go.mod": "go", "Cargo.toml": "cargo", "pyproject.toml": "pypi"}
VENDORED = r"(^|/)(node_modules|vendor|\.venv|venv|site-packages)/"


def declared(path: str, content: str) -> list[tuple[str, str, str | None, str]]:
    """(ecosystem, name, version, scope) of one manifest; nothing for one that can't be read."""
    name = path.rsplit("/", 1)[-1]
    out: list[tuple[str, str, str | None, str]] = []
    try:
        if name == "package.json":
            data = json.loads(content)
            for key, scope in (("dependencies", "runtime"), ("devDependencies", "development"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")):
                out += [("npm", n, v if isinstance(v, str) else None, scope) for n, v in (data.get(key) or {}).items()]
        elif name == "go.mod":
            required = re.findall(r"^\s*(?:require\s+)?([\w.\-/]+\.[\w.\-/]+)\s+(v[^\s/]+)(\s*//\s*indirect)?", content, re.M)
            out += [("go", n, v, "indirect" if i else "runtime") for n, v, i in required]
        elif name == "Cargo.toml":
            data = tomllib.loads(content)
            for key, scope in (("dependencies", "runtime"), ("dev-dependencies", "development"), ("build-dependencies", "build")):
                out += [("cargo", n, v if isinstance(v, str) else (v or {}).get("version"), scope) for n, v in (data.get(key) or {}).items()]
        elif name == "pyproject.toml":
            data = tomllib.loads(content)
            project = data.get("project") or {}
            groups = [("runtime", project.get("dependencies") or []), *((g, d) for g, d in (project.get("optional-dependencies") or {}).items())]
            for scope, items in groups:
                out += [("pypi", *requirement(i), scope) for i in items if isinstance(i, str) and requirement(i)]
        elif re.fullmatch(r"requirements.*\.txt", name):
            lines = [line.split("#")[0].strip() for line in content.splitlines()]
            out += [("pypi", *requirement(line), "runtime") for line in lines if line and not line.startswith("-") and requirement(line)]
    except (ValueError, AttributeError, TypeError):
        return []
    return out


def requirement(text: str) -> tuple[str, str | None] | None:
    """Normalised name and version constraint of a requirement line."""
    found = re.match(r"([A-Za-z0-9][\w.\-]*)\s*(?:\[[^\]]*\])?\s*([^;]*)", text)
    return (re.sub(r"[-_.]+", "-", found[1]).lower(), found[2].strip() or None) if found else None


def read_manifests(files: DataFrame) -> DataFrame:
    """(path, ecosystem, name, version, scope) of manifest rows (path, content); vendored ones are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *d) for p, c in zip(batch["path"], batch["content"]) for d in declared(p, c or "")]
            yield pd.DataFrame(rows, columns=["path", "ecosystem", "name", "version", "scope"])

    known = F.regexp_extract("path", "[^/]+$", 0)
    wanted = files.where(known.isin(*MANIFESTS) | known.rlike(r"^requirements.*\.txt$")).where(~F.col("path").rlike(VENDORED))
    return wanted.select("path", "content").mapInPandas(run, "path string, ecosystem string, name string, version string, scope string")
