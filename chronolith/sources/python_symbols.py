"""Definitions, imports and call sites of Python sources; the parsing of one file is the only row-wise step."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MAX_CHARS = 1_000_000
SYMBOLS = "path string, qualified_name string, kind string, start_line int, end_line int, content_hash string, shape_hash string"
IMPORTS = "path string, specifier string, name string, line int"
CALLS = "path string, caller string, callee string, line int"


def _tree(source: str | None) -> ast.Module | None:
    if not source or len(source) > MAX_CHARS:
        return None
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None


def definitions(source: str | None) -> list[tuple]:
    """(qualified name, kind, first line, last line, content hash, shape hash without the own name)."""
    tree = _tree(source)
    out: list[tuple] = []

    def walk(node: ast.AST, scope: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{scope}{child.name}"
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                body = ast.get_source_segment(source, child) or ""
                shape = re.sub(rf"(?<![\w$]){re.escape(child.name)}(?![\w$])", "", body)
                out.append((name, kind, child.lineno, child.end_lineno, hashlib.sha256(body.encode()).hexdigest(), hashlib.sha256(shape.encode()).hexdigest()))
                walk(child, f"{name}.", kind == "class")
            else:
                walk(child, scope, in_class)

    if tree:
        walk(tree, "", False)
    return out


def imported(source: str | None) -> list[tuple]:
    out: dict[tuple, int] = {}
    for node in ast.walk(_tree(source) or ast.Module([], [])):
        if isinstance(node, ast.Import):
            for a in node.names:
                out.setdefault((a.name, "*"), node.lineno)
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                out.setdefault(("." * node.level + (node.module or ""), a.name), node.lineno)
    return [(*k, line) for k, line in out.items()]


def called(source: str | None) -> list[tuple]:
    """(innermost definition around the call, dotted callee, line), each pair once at its first line."""
    out: dict[tuple, int] = {}

    def dotted(node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        head = dotted(node.value) if isinstance(node, ast.Attribute) else None
        return f"{head}.{node.attr}" if head else None

    def walk(node: ast.AST, scope: str) -> None:
        for child in ast.iter_child_nodes(node):
            inner = f"{scope}.{child.name}".lstrip(".") if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else scope
            if isinstance(child, ast.Call) and (name := dotted(child.func)):
                key = (scope or None, name)
                out[key] = min(out.get(key, child.lineno), child.lineno)
            walk(child, inner)

    walk(_tree(source) or ast.Module([], []), "")
    return [(*k, line) for k, line in out.items()]


def _extract(files: DataFrame, one, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            yield pd.DataFrame([(p, *row) for p, c in zip(batch["path"], batch["content"]) for row in one(c)], columns=names)

    return files.where("path LIKE '%.py'").select("path", "content").mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    """Symbol rows of files (path, content); unreadable and very long files have none."""
    return _extract(files, definitions, SYMBOLS)


def imports(files: DataFrame) -> DataFrame:
    return _extract(files, imported, IMPORTS)


def calls(files: DataFrame) -> DataFrame:
    return _extract(files, called, CALLS)
