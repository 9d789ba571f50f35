"""Exact measures of Python sources by the standard parser: callables, their complexity, outlines and comments."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRANCHES = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert)
BLOCKS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
CALLABLES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
FUNCTIONS = "path string, name string, symbol_key string, line long, end_line long, cyclomatic long, cognitive long, max_nesting long"
OUTLINES = "path string, name string, kind string, signature string, line long, exported boolean"


def _catch_all(case: ast.match_case) -> bool:
    return isinstance(case.pattern, ast.MatchAs) and case.pattern.pattern is None and case.guard is None


def measured(root: ast.AST) -> tuple[int, int, int]:
    """Decisions, cognitive complexity and deepest nesting of a scope, without the callables within it."""
    decisions = cognitive = deepest = 0
    stack = [(node, 0, False) for node in ast.iter_child_nodes(root)]
    while stack:
        node, depth, chained = stack.pop()
        if isinstance(node, CALLABLES):
            continue
        inner = depth
        if isinstance(node, BRANCHES):
            decisions += 1
            cognitive += 1 if chained else 1 + depth
        elif isinstance(node, ast.BoolOp):
            decisions += len(node.values) - 1
            cognitive += 1
        elif isinstance(node, ast.comprehension):
            decisions += 1 + len(node.ifs)
            cognitive += 1 + len(node.ifs)
        elif isinstance(node, ast.Match):
            decisions += sum(not _catch_all(c) for c in node.cases)
            cognitive += 1 + depth
        if isinstance(node, BLOCKS) and not chained:
            inner = depth + 1
            deepest = max(deepest, inner)
        for child in ast.iter_child_nodes(node):
            elif_ = isinstance(node, ast.If) and node.orelse == [child] and isinstance(child, ast.If)
            stack.append((child, depth if elif_ and not chained else inner, elif_))
    return decisions, cognitive, deepest


def callables(source: str) -> list[dict]:
    """A record for each function and lambda, in order, keyed by its qualified name and its number among equal names."""
    out, seen = [], {}

    def walk(node: ast.AST, outer: str) -> None:
        for child in ast.iter_child_nodes(node):
            name = outer
            if isinstance(child, ast.ClassDef):
                name = f"{outer}{child.name}."
            elif isinstance(child, CALLABLES):
                own = getattr(child, "name", "lambda")
                key = outer + own
                seen[key] = seen.get(key, 0) + 1
                decisions, cognitive, deepest = measured(child)
                calls = any(isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id == own for x in ast.walk(child))
                out.append({"name": own, "symbol_key": key if seen[key] == 1 else f"{key}#{seen[key]}", "line": child.lineno, "end_line": child.end_lineno, "cyclomatic": 1 + decisions, "cognitive": cognitive + calls, "max_nesting": deepest})
                name = f"{key}."
            walk(child, name)

    walk(ast.parse(source), "")
    return sorted(out, key=lambda x: (x["line"], x["symbol_key"]))


def file_cyclomatic(source: str) -> int:
    """The sum over callables and the decisions outside of them; one more than those where there is no callable."""
    some = callables(source)
    return sum(x["cyclomatic"] for x in some) + measured(ast.parse(source))[0] + (not some)


def outline(source: str) -> list[dict]:
    """Classes and functions with their header in one line, cut to 280 characters; exported: no leading underscore, or in __all__."""
    tree, lines, out = ast.parse(source), source.splitlines(), []
    listed = {x.value for node in tree.body if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)) for x in node.value.elts if isinstance(x, ast.Constant)}

    def walk(body: list[ast.stmt], outer: str) -> None:
        for node in body:
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                first = node.body[0]
                head = [*lines[node.lineno - 1 : first.lineno - 1], lines[first.lineno - 1].encode()[: first.col_offset].decode()]
                header = " ".join(" ".join(head).split()).removesuffix(":")
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if outer else "function"
                out.append({"name": outer + node.name, "kind": kind, "signature": header[:280], "line": node.lineno, "exported": node.name in listed or not node.name.startswith("_") and not listed})
                if kind == "class":
                    walk(node.body, f"{outer}{node.name}.")

    walk(tree.body, "")
    return out


def _table(files: DataFrame, f, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [{"path": path} | x for x in f(content)]
                except (SyntaxError, ValueError, RecursionError):
                    continue  # a file that doesn't parse has no records
            yield pd.DataFrame(rows, columns=columns)

    python = files.where((F.col("language") == "Python") & F.col("content").isNotNull())
    return python.select("path", "content").mapInPandas(run, schema)


def functions(files: DataFrame) -> DataFrame:
    return _table(files, callables, FUNCTIONS)


def outlines(files: DataFrame) -> DataFrame:
    return _table(files, outline, OUTLINES)
