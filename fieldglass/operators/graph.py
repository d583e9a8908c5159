"""Strongly connected components of a directed graph: groups of nodes that reach one another, such as recursion groups of a call graph.

Trimming drops edges that cannot lie on a cycle; then every node takes the smallest node that reaches it as its colour, and
within a colour the nodes that reach that smallest node are its component. Components found go, the rest starts again. Every step
is a minimum or a distinct per node, combined before the shuffle, and a join with the edges; each round is written, so lineage
stays short. Rounds follow the longest shortest path within a colour, not the number of nodes.

Nulls and edges: an edge with a null end is left out; repeated edges count once; a loop makes its node recursive but joins
nothing; a node without a cycle is a component of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.stages import settle

#: Rounds of trimming before each colouring; bears on speed only.
TRIMS = 2


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose start has an edge into it and whose end has one out of it."""
    for _ in range(TRIMS):
        into, out = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
        edges = edges.join(into, "a", "left_semi").join(out, "b", "left_semi").select("a", "b")
    return settle(edges, "edges")


def _coloured(edges: DataFrame) -> DataFrame:
    """node, colour: the smallest node that reaches it, or itself."""
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = settle(ends.withColumn("colour", F.col("node")).withColumn("moved", F.lit(True)), "colours")
    while True:
        sent = edges.join(labels.filter("moved"), F.col("a") == F.col("node")).groupBy(F.col("b").alias("to")).agg(F.min("colour").alias("offered"))
        better = F.col("offered").isNotNull() & (F.col("offered") < F.col("colour"))
        labels = settle(labels.join(sent, F.col("node") == F.col("to"), "left").select("node", F.when(better, F.col("offered")).otherwise(F.col("colour")).alias("colour"), better.alias("moved")), "colours")
        if labels.filter("moved").isEmpty():
            return labels.select("node", "colour")


def _reaching(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """node, component: the nodes that reach the node which their colour is named after, within the colour."""
    a, b = colours.select(F.col("node").alias("a"), F.col("colour").alias("ca")), colours.select(F.col("node").alias("b"), F.col("colour").alias("cb"))
    inside = settle(edges.join(a, "a").join(b, "b").filter("ca = cb").select("a", "b", F.col("ca").alias("colour")), "inside")
    reached = frontier = settle(colours.filter("node = colour").select("node", F.col("colour").alias("component")), "reached")
    while True:
        step = inside.join(frontier, F.col("b") == F.col("node")).select(F.col("a").alias("node"), F.col("colour").alias("component")).distinct()
        frontier = settle(step.join(reached.select("node"), "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            return reached
        reached = settle(reached.unionByName(frontier), "reached")


def strong_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node), size, recursive (on a cycle or with a loop): one row a node."""
    every = settle(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "edges")
    nodes = every.select(F.col("a").alias("node")).union(every.select(F.col("b").alias("node"))).distinct()
    loops = every.filter("a = b").select(F.col("a").alias("node"), F.lit(True).alias("loop"))
    left, found = every.filter("a <> b"), None
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            break
        part = _reaching(left, _coloured(left))
        found = part if found is None else found.unionByName(part)
        gone_a, gone_b = part.select(F.col("node").alias("a")), part.select(F.col("node").alias("b"))
        left = left.join(gone_a, "a", "left_anti").join(gone_b, "b", "left_anti").select("a", "b")
    named = nodes.withColumn("component", F.col("node")) if found is None else nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    sizes = named.groupBy(F.col("component").alias("of")).agg(F.count(F.lit(1)).alias("size"))
    out = named.join(sizes, F.col("component") == F.col("of")).join(loops, "node", "left")
    return out.select("node", "component", "size", (F.coalesce("loop", F.lit(False)) | (F.col("size") > 1)).alias("recursive"))
