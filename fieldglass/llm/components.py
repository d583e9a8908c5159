"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum per node (combined before the shuffle) and a join back to the edges, so a hub's
edges are never gathered in one task: the join splits hot keys at run time. Each round is
written to the shared folder. Works for any node type that has an order; edges of longs first become
stars within each task, which leaves a small table no rounds at all.

A round's plan names its edges as few times as it can, and there are as few rounds as can be: what the driver holds
for a round (plans, their texts in events, a thread for each exchange) does not depend on the number of edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import materialize


def _pull(edges: DataFrame) -> DataFrame:
    """Edges (u, v), each u's smallest neighbour or itself beside them as m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("w")).drop("w")


def _each(edges: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """For every row one edge (u, v) from each of the named pairs; unlike a union, the input stands in the plan once."""
    pairs: list[Column] = [F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ends]
    return edges.select(F.explode(F.array(*pairs)).alias("e")).select("e.u", "e.v")


def large_star(edges: DataFrame) -> DataFrame:
    return _pull(_each(edges, ("u", "v"), ("v", "u"))).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _each(_pull(down), ("v", "m"), ("u", "m")).filter(F.col("u") != F.col("v")).distinct()


#: Edges that a task makes stars of at once; bears on memory and speed only.
AT_ONCE = 1 << 19


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of these edges with the smallest that it reaches over them, itself left out: the larger root hangs on the smaller."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[hung], nodes[root[hung]]


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for batch in batches:
        held.append(batch[["u", "v"]].to_numpy(np.int64))
        n += len(batch)
        if n >= AT_ONCE:
            yield pd.DataFrame(dict(zip("uv", _stars(*np.concatenate(held).T))))
            held, n = [], 0
    if n:
        yield pd.DataFrame(dict(zip("uv", _stars(*np.concatenate(held).T))))


def _finished(edges: DataFrame) -> bool:
    """Whether every component is a star: edges lead from a node with no other edge to a smaller one that has none itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("down")))).alias("e"))
    nodes = ends.groupBy("e.x").agg(F.sum("e.down").alias("down"), F.min("e.down").alias("least"))
    return nodes.filter("down > 1 or down > 0 and least = 0").agg(F.count(F.lit(1)).alias("n")).first()["n"] == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest reachable node): one row a node that has an edge to another node.

    Null ends and loops are ignored, repeated edges count once. Ends when all components are stars; the number of
    rounds grows with the logarithm of the longest path.
    """
    edges = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    if {kind for _, kind in edges.dtypes} == {"bigint"}:
        edges = edges.mapInPandas(_contracted, "u long, v long")
    edges = materialize(edges, "edges")
    while not _finished(edges):
        edges = materialize(small_star(large_star(edges)), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
