"""What a repository path tells: language, test, generated, illustrative, scope."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by language, and the conventions of tests and generated files.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "cs": "csharp",
    "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "swift": "swift",
    "md": "markdown", "json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml",
    "sql": "sql", "css": "css", "html": "html", "sh": "shell",
}
GRAMMARS = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "rb": "ruby", "php": "php",
}
NON_CODE = ("markdown", "json", "yaml", "toml")
TEST = r"(?i)(^|/)(tests?|__tests__|spec)/|[._-](test|spec)\.[a-z]+$|(^|/)test_[^/]+\.py$|_test\.go$"
TEST_CLASS = r"[a-z0-9](Tests?|Spec)\.(java|kt|cs|php)$"
GENERATED = (
    r"(^|/)(pnpm-lock\.yaml|package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|bun\.lockb?|Cargo\.lock|go\.sum|poetry\.lock|uv\.lock|Pipfile\.lock|Gemfile\.lock|composer\.lock)$"
    r"|(^|/)(dist|build|out|coverage|vendor|node_modules|__snapshots__)/|\.min\.(js|css)$|\.(snap|map)$|_snapshot\.json$"
)
ILLUSTRATIVE = r"(?i)(^|/)(examples?|samples?|demos?|docs?|fixtures?|benchmarks?|__mocks__)/"
DECLARATION = r"\.d\.[cm]?ts$"


def _extension(path: Column) -> Column:
    """Lower-case extension of the last path segment; none for a name that only begins with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def _looked_up(path: Column, table: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))[_extension(path)]


def language(path: Column) -> Column:
    return _looked_up(path, LANGUAGES)


def grammar(path: Column) -> Column:
    return _looked_up(path, GRAMMARS)


def is_test(path: Column) -> Column:
    return path.rlike(TEST) | path.rlike(TEST_CLASS)


def is_generated(path: Column) -> Column:
    return path.rlike(GENERATED)


def is_illustrative(path: Column) -> Column:
    return path.rlike(ILLUSTRATIVE)


def is_declaration(path: Column) -> Column:
    return path.rlike(DECLARATION)


def is_code(path: Column) -> Column:
    found = language(path)
    return found.isNotNull() & ~found.isin(*NON_CODE)


def in_scope(path: Column, scope: str | None) -> Column:
    """The path itself or something below it; a common beginning of names is not enough."""
    prefix = (scope or "").rstrip("/")
    return F.lit(True) if not prefix else (path == prefix) | path.startswith(prefix + "/")


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first, the root ('') last."""
    parts = F.split(directory(path), "/")
    depth = F.when(directory(path) == "", 0).otherwise(F.size(parts))
    return F.transform(F.sequence(depth, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
