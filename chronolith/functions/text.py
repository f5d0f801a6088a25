"""What commit, issue and pull-request texts say: fixes, workarounds, versions, deadlines, references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording that counts. No look-around, so that every regular-expression engine agrees.
BUG_LABEL = r"(?i)\b(bug|defect|regression|crash|incident)\b"
REVERT = r'(?im)^Revert "|This reverts commit [0-9a-f]{7,}'
CONVENTIONAL_FIX = r"(?i)^(?:fix|hotfix|bugfix)(?:\([^)]*\))?!?:"
FIX_WORDS = r"(?i)\b(?:fix(?:es|ed)?|bug(?:fix)?|hotfix|crash(?:es|ed)?|regression|broken)\b"
NOT_A_DEFECT = (
    r"(?i)\b(?:typos?|spelling|lint(?:ing)?|format(?:ting)?|docs?|documentation|jsdoc|comments?|readme|changelog|whitespace|bump(?:s|ed)?|deps|dev-?deps|dependenc(?:y|ies)|dependabot|renovate|typing|type[- ]?hints?|annotations?|mypy|pyright|flake8|pylint|ruff|isort|eslint|prettier)\b"
    r"|^(?:fix|hotfix|bugfix)\((?:deps|deps-dev|dev-?deps|ci|build|docs?|tests?|lint|release|chore|types|refactor|style|perf)\)"
)
WORKAROUND = (
    r"\bwork[- ]?arounds?\b|\bhack(?:s|y|ish)?\b|\bkludge\b|\btemporar(?:y|ily)\b|\bcompat(?:ibility|ible)?\b|\bpolyfills?\b|\bshims?\b|\blegacy\b|\bdeprecat(?:e|ed|es|ion)\b"
    r"|\bbackport(?:s|ed)?\b|\bmonkey[- ]?patch(?:es|ed)?\b|\bremove (?:this |it )?(?:once|when|after)\b|\bfor (?:older|old) (?:versions?|browsers|clients|releases)\b"
)
REMOVAL = r"(?i)\b(?:remov(?:e|es|ed|ing)|drop(?:s|ped|ping)?|delet(?:e|es|ed|ing)|clean(?:s|ed)? up|get(?:ting)? rid of|no longer|kill(?:s|ed)?|revert(?:s|ed)?)\b"
VERSIONS = {
    "node": r"(?i)\bnode(?:\.?js)?\s*v?(\d{1,2})(?:\.(\d{1,2}))?(?:\.x)?\b",
    "python": r"(?i)\bpython\s*(\d)(?:\.(\d{1,2}))?\b",
    "go": r"(?i)\bgo\s*(1)\.(\d{1,2})\b",
    "rust": r"(?i)\brustc?\s*(1)\.(\d{1,3})\b",
}
DEADLINE = r"(?i)\b(?:until|till|before|after|by|remove (?:in|after|by|on)|expires?(?: on)?|deadline)\s+(\d{4}-\d{2}(?:-\d{2})?|Q[1-4]\s+\d{4}|\d{4})\b"
CLOSING = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)[ \t]*:?[ \t]+$"
REFERENCE = r"(?i)(^|[^\w/&#.-])(?:([\w.-]+/[\w.-]+)#|#|GH-)(\d+)\b"
CLOSING_WINDOW, MAX_REFERENCE_TEXT, EXCERPT = 24, 100_000, 160
REVERTED_SHA = r"This reverts commit ([0-9a-f]{7,40})"
TRACKER_KEY = r"\b([A-Z][A-Z0-9]+-[1-9][0-9]*)\b"
EARLIEST_YEAR, LATEST_YEAR = 2000, 2100
ANONYMOUS_EMAIL = r"(?i)^(|.*noreply.*|.*@localhost.*|unknown|none)$"


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def first_paragraph(body: Column, limit: int = 240) -> Column:
    flat = F.trim(F.regexp_replace(F.split(body, r"\n\s*\n")[0], r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def signature(text: Column, limit: int = 200) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def name_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def is_anonymous(email: Column) -> Column:
    return F.trim(email).rlike(ANONYMOUS_EMAIL)


def version_references(text: Column) -> Column:
    """Array of (runtime, major, minor, phrase) in runtime order; minor is null for a bare major version."""
    found = []
    for runtime, pattern in VERSIONS.items():
        parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for g, n in ((0, "phrase"), (1, "major"), (2, "minor"))])
        found.append(_typed(parts, runtime))
    return F.concat(*found)


def _typed(parts: Column, runtime: str) -> Column:
    def row(p: Column) -> Column:
        minor = F.when(p["minor"] != "", p["minor"].cast("int"))
        return F.struct(F.lit(runtime).alias("runtime"), p["major"].cast("int").alias("major"), minor.alias("minor"), p["phrase"].alias("phrase"))

    return F.transform(parts, row)


def is_below(major: Column, minor: Column, least_major: Column, least_minor: Column) -> Column:
    """Older than the oldest supported version; a bare major version names its whole series."""
    return F.when(major != least_major, major < least_major).otherwise(minor.isNotNull() & (minor < least_minor))


def deadline_end(written: Column) -> Column:
    """Last day that a written date covers; null if its year or month is out of range. A day past its month's end rolls over."""
    quarter = F.regexp_extract(written, r"(?i)^Q([1-4])", 1)
    year = F.when(quarter != "", F.regexp_extract(written, r"(\d{4})$", 1)).otherwise(F.substring(written, 1, 4)).cast("int")
    month = F.when(quarter != "", quarter.cast("int") * 3).when(F.length(written) >= 7, F.substring(written, 6, 2).cast("int"))
    whole = F.when(month.isNull(), F.make_date(year, F.lit(12), F.lit(31))).when(
        (quarter != "") | (F.length(written) == 7), F.last_day(F.make_date(year, F.when(month.between(1, 12), month).otherwise(1), F.lit(1)))
    )
    exact = F.date_add(F.make_date(year, F.when(month.between(1, 12), month).otherwise(1), F.lit(1)), F.substring(written, 9, 2).cast("int") - 1)
    known = year.between(EARLIEST_YEAR, LATEST_YEAR) & (month.isNull() | month.between(1, 12))
    return F.when(known, F.coalesce(whole, exact))


def deadlines(text: Column) -> Column:
    """Array of written deadline dates."""
    return F.regexp_extract_all(text, F.lit(DEADLINE), F.lit(1))


def minimum_version(constraint: Column) -> Column:
    """Struct (major, minor) of the oldest version that a constraint admits; null without a lower bound."""
    lower = F.regexp_replace(F.concat_ws(" , ", F.split(constraint, r"\|\|")), r"(?:<=?|!=)\s*v?\d+(?:\.(?:\d+|x|\*))*", " ")
    pattern = F.lit(r"(?:^|[\s,(])(?:>=|>|\^|~=|~|==|=)?\s*v?(\d+)(?:\.(\d+|x|\*))?")
    parts = F.arrays_zip(F.regexp_extract_all(lower, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(lower, pattern, F.lit(2)).alias("b"))
    return F.array_min(F.transform(parts, lambda p: F.struct(p["a"].cast("int").alias("major"), F.when(p["b"].rlike(r"^\d+$"), p["b"].cast("int")).otherwise(0).alias("minor"))))


def reference_rows(text: Column, owner: str, name: str) -> Column:
    """Array of (number, repo, closing), once per reference: closing if any mention is.

    The text is cut before each reference (all matches and what stands between them keep their
    order), so the closing keyword is looked for right before it.
    """
    cut = F.substring(text, 1, MAX_REFERENCE_TEXT)
    before = F.split(cut, r"(?i)(?<![\w/&#.-])(?:(?:[\w.-]+/[\w.-]+)?#|GH-)\d+\b")
    numbers = F.regexp_extract_all(cut, F.lit(REFERENCE), F.lit(3))
    repos = F.regexp_extract_all(cut, F.lit(REFERENCE), F.lit(2))
    own = f"{owner}/{name}".lower()

    def row(z: Column) -> Column:
        repo = F.lower(z["repo"])
        return F.struct(z["number"].cast("bigint").alias("number"), F.when((repo != "") & (repo != own), repo).alias("repo"), F.substring(z["before"], -CLOSING_WINDOW, CLOSING_WINDOW).rlike(CLOSING).alias("closing"))

    return F.filter(F.transform(F.arrays_zip(numbers.alias("number"), repos.alias("repo"), F.slice(before, F.lit(1), F.size(numbers)).alias("before")), row), lambda r: r["number"] > 0)
