"""Mix sources to target weights by the cube method.

Every source has a target; the ratio of target to size says how often its words are taken. The
whole part takes each document that often; the fraction is each document's inclusion probability for one
more copy. The cube method makes that choice: a flight phase moves the vector of
probabilities along directions in the null space of two balancing constraints (words and documents), three
documents at a time, so both totals stay exact, until few are undecided. It runs in
blocks of about a thousand documents of one source; what blocks leave undecided flies again,
level by level, until one group per source is left. Its last ten documents are the landing problem, solved by trying
all outcomes and taking the one nearest the word target. A source of any size is so split into
bounded groups. Choices depend on the documents' hashes and a seed only, never on partitions. Rows that are equal throughout are
counted before they are dealt and numbered by their count, so however many there are, they are spread over blocks. Sources are few by
nature (their targets are one small table, worked out in one task; a source a host or url is not meant).

Nulls and edges: a null source is one source of its own, last in order; a null or empty text has size 0; rows with
equal or null ids are separate documents; a source whose size is 0 has target 0 and takes nothing; an empty table
gives an empty result. Columns other than the id, source and text are ignored, whatever their names.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import materialize, split_id, word_count

EPS = 1e-9
#: Documents of a source that the landing decides, by trying all their outcomes.
LANDING = 10


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, n_docs, target: one row a source.

    Sources in code-point order (null last) get the weights in turn and share ``share`` of all
    sizes; no target is above ``cap`` times its source's size, the excess goes to the others by weight. In the
    end an uncapped target is weight times one level, so capped sources are those with the least cap
    per weight; the level follows from running sums over the sources (one row each).
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = by_source.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("at", F.col("most") / F.col("w"))
    rising = Window.orderBy("at", F.col("source").asc_nulls_last())
    before, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    levels = ranked.withColumn("level", level).withColumn("k", F.row_number().over(rising))
    free = levels.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("at"), F.col("k"))).over(everything))
    return free.select("source", "source_size", "n_docs", F.least("most", F.col("w") * F.coalesce("level", F.max("at").over(everything))).alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, rng: random.Random, leave: int = 2) -> np.ndarray:
    """Moves probabilities until at most ``leave`` (two or more) stay between 0 and 1, keeping their sum and the sum of pi * size."""
    pi, active = pi.copy(), []
    to_come = int(((pi > EPS) & (pi < 1 - EPS)).sum())
    for k in np.flatnonzero((pi > EPS) & (pi < 1 - EPS)):
        if len(active) + to_come <= leave:
            break
        active.append(k)
        to_come -= 1
        while len(active) > 2 or len(active) == 2 and size[active[0]] == size[active[1]]:
            active = _move(pi, size, active, rng)
    return pi


def _move(pi: np.ndarray, size: np.ndarray, active: list[int], rng: random.Random) -> list[int]:
    if len(active) == 2:
        way = (1.0, -1.0)
    else:
        a, b, c = (float(size[k]) for k in active)
        way = (c - b, a - c, b - a)
        way = way if any(way) else (1.0, -1.0, 0.0)
    up = min((1 - pi[k]) / u if u > 0 else pi[k] / -u for k, u in zip(active, way) if u)
    down = min(pi[k] / u if u > 0 else (1 - pi[k]) / -u for k, u in zip(active, way) if u)
    step = up if rng.random() * (up + down) < down else -down
    left = []
    for k, u in zip(active, way):
        pi[k] += step * u
        if pi[k] <= EPS or pi[k] >= 1 - EPS:
            pi[k] = round(pi[k])
        else:
            left.append(k)
    return left


def landing(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The undecided (``LANDING`` at most) become 0 or 1: the outcome nearest in words, then in documents, then the first."""
    pi, open_ = np.where(pi > 1 - EPS, 1.0, np.where(pi < EPS, 0.0, pi)), np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    outcomes = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
    off = np.abs(outcomes @ size[open_] - (pi[open_] * size[open_]).sum()), np.abs(outcomes.sum(axis=1) - pi[open_].sum())
    pi[open_] = outcomes[np.lexsort((np.arange(len(outcomes)), off[1], off[0]))[0]]
    return pi


def _flier(seed: int, level: int, last: bool):
    """The flight over one group; on the last level the landing follows."""

    def fly(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "dn", "d", "size"], kind="stable")
        pi, size = group["pi"].to_numpy(float), group["size"].to_numpy(np.int64)
        pi = flight(pi, size, random.Random(f"{seed}|{group['source'].iloc[0]!r}|{level}|{group['block'].iloc[0]}"), LANDING if last else 2)
        return group.assign(pi=landing(pi, size) if last else pi)

    return fly


def balanced_sample(units: DataFrame, block_docs: int = 1024, seed: int = 42) -> DataFrame:
    """Adds ``chosen`` (0 or 1) to rows (doc_id, source, size, n_docs, pi, rh, h); ``n_docs`` is the number of rows of the source, ``h`` a hash that tells rows apart."""
    rows = units.withColumn("block", F.pmod("h", F.ceil(F.col("n_docs") / block_docs)).cast("long"))
    rows = rows.select(*split_id(F.col("doc_id")), "source", "size", "n_docs", "pi", "rh", "h", "block")
    schema, most = rows.schema, (units.agg(F.max("n_docs")).first()[0] or 1)
    groups, level, done = -(-most // block_docs), 0, []
    while True:
        last = groups <= 1
        flown = rows.groupBy("source", "block").applyInPandas(_flier(seed, level, last), schema)
        if last:
            done.append(flown)
            break
        flown = materialize(flown, f"cube-{level}")
        settled = (F.col("pi") <= 0) | (F.col("pi") >= 1)
        done.append(flown.filter(settled))
        fan_in = max(2, block_docs // 2)  # each group leaves two at most
        rows = flown.filter(~settled).withColumn("block", F.floor(F.col("block") / fan_in))
        groups, level = -(-groups // fan_in), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.when(~F.col("dn"), F.col("d")).alias("doc_id"), "source", "size", F.col("pi").cast("int").alias("chosen"), "rh")


def _copies(docs: DataFrame, row_hash: Column, weights: Sequence[float], share: float, cap: float, id_col: str, source_col: str, text_col: str, block_docs: int, seed: int) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, rh: one row a document."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), row_hash.alias("rh"))
    counted = materialize(own.groupBy("doc_id", "source", "size", "rh").agg(F.count(F.lit(1)).alias("n_same")), "sizes")
    sizes = counted.select("doc_id", "source", "size", "rh", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_same"))).alias("k"))
    targets = source_targets(sizes, weights, share, cap).select(F.col("source").alias("its"), "source_size", "n_docs", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + F.lit(EPS))
    units = sizes.join(targets, sizes["source"].eqNullSafe(targets["its"]), "left").drop("its").withColumn("pi", F.greatest(F.lit(0.0), ratio - whole)).withColumn("h", F.xxhash64("rh", "k"))
    chosen = balanced_sample(units, block_docs, seed)
    joined = chosen.join(targets.withColumn("whole", whole), chosen["source"].eqNullSafe(targets["its"]), "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("chosen")).cast("int").alias("copies"), "rh")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_docs: int = 1024, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (= copies * size): one row a document."""
    row_hash = F.xxhash64(F.col(id_col).cast("long"), F.col(source_col), F.col(text_col))
    out = _copies(docs, row_hash, weights, share, cap, id_col, source_col, text_col, block_docs, seed)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_docs: int = 1024, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns stay, whatever their names.

    Rows are told apart by all their columns; rows equal in all are one row that is taken as often as they are together.
    """
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    copies = _copies(docs, row_hash, weights, share, cap, id_col, source_col, text_col, block_docs, seed).groupBy("rh").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    own = docs.select(row_hash.alias("own"), F.struct("*").alias("row")).repartition("own").dropDuplicates(["own"])
    return own.join(copies, F.col("own") == F.col("rh")).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
