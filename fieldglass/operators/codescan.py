"""Findings that need a syntax tree: a small per-row helper inside an Arrow batch function.

Nulls and edges: code that does not parse has ``parsed`` false and no facts; null or empty code parses and has none; repeated snippets are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from fieldglass.functions.stages import dealt, small_batches

FACTS = "snippet_id string, parsed boolean, loop_depth int, recursive_calls int, complexity string, imports array<string>, functions array<string>, calls array<string>, edges array<string>, frames array<string>"


def _depth(node: ast.AST, depth: int = 0) -> int:
    inner = depth + isinstance(node, (ast.For, ast.While, ast.AsyncFor, ast.comprehension))
    return max([inner, *(_depth(x, inner) for x in ast.iter_child_nodes(node))])


def _name(node: ast.AST) -> str | None:
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else None


def _halves(tree: ast.AST) -> bool:
    """A loop that halves something: integer division by two inside a while."""
    return any(isinstance(x, ast.BinOp) and isinstance(x.op, ast.FloorDiv) and isinstance(x.right, ast.Constant) and x.right.value == 2 for w in ast.walk(tree) if isinstance(w, ast.While) for x in ast.walk(w))


def facts(snippet_id: str, code: str | None) -> tuple:
    """What the tree of one snippet says; code that does not parse has no facts."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError):
        return snippet_id, False, 0, 0, "Unknown", [], [], [], [], []
    functions = [x for x in ast.walk(tree) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
    calls, edges, own = [], [], 0
    for x in ast.walk(tree):
        if isinstance(x, ast.Call) and _name(x.func):
            calls.append(_name(x.func))
    for f in functions:
        inside = [_name(c.func) for c in ast.walk(f) if isinstance(c, ast.Call)]
        edges += [f"{f.name}>{c}" for c in inside if c]
        own = max(own, inside.count(f.name))
    imports = sorted({a.name.split(".")[0] for x in ast.walk(tree) if isinstance(x, ast.Import) for a in x.names} | {x.module.split(".")[0] for x in ast.walk(tree) if isinstance(x, ast.ImportFrom) and x.module})
    frames = sorted({t.id for x in ast.walk(tree) if isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and _name(x.value.func) in ("DataFrame", "read_csv", "read_parquet") for t in x.targets if isinstance(t, ast.Name)})
    depth = _depth(tree)
    big_o = "O(2^n)" if own > 1 else "O(n)" if own == 1 and depth == 0 else "O(log n)" if depth == 1 and _halves(tree) else ("O(1)", "O(n)", "O(n^2)", "O(n^3)")[depth] if depth < 4 else f"O(n^{depth})"
    return snippet_id, True, depth, own, big_o, imports, [f.name for f in functions], calls, sorted(set(edges)), frames


def scan(code: DataFrame) -> DataFrame:
    """One row of facts a snippet: loop depth, recursion, complexity class, imports, functions, calls, call edges, data-frame variables.

    Snippets are dealt to all tasks first, as files of few row groups would keep few busy; of equal code in a batch the tree is built once.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in FACTS.split(", ")]
        for batch in batches:
            of, distinct = pd.factorize(batch["code"].fillna(""))
            said = pd.DataFrame([facts("", c)[1:] for c in distinct], columns=names[1:]).take(of).reset_index(drop=True)
            said.insert(0, "snippet_id", batch["snippet_id"])
            yield said

    small_batches(code.sparkSession)
    return dealt(code.select("snippet_id", "code")).mapInPandas(each, FACTS)
