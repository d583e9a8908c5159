"""Approximate nearest neighbours by multi-index hashing over learned, rotated binary codes.

Codes: vectors are scaled to length one, centred, turned to their principal axes and rotated so that signs lose least
(iterative quantization, fitted on at most ``sample_rows`` vectors); the signs are the code. Every row
is indexed. A shard of the index splits its codes into byte substrings and keeps an inverted list per
substring value. Bounds on the ``m`` substrings that add up to ``r + 1 - m`` are enough: a code that exceeds each
of them differs in at least ``r + 1`` bits (pigeonhole). So ``(r + 1) % m`` lists are probed to ``(r + 1) // m`` bits and
the others to one bit less, which retrieves every code within radius ``r``; those are checked on the whole code, then reranked by the cosine of the float vectors. The
radius is fitted on the sample so that ``aim`` of the true neighbours lie within it; a query that finds fewer
than ``k`` within the radius has its radius widened until it has ``k`` or all rows.

Queries are a stated set; they meet the index in blocks (``block`` queries by ``shard`` rows), each pair of blocks one task;
the best ``k`` of each pair are merged. Equal vectors of a shard are one entry that keeps its k+1 smallest ids (no more can be among the
k nearest), so a vector repeated without bound costs one entry.

Nulls and edges: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite
components take no part; null ids take no part; repeated ids are separate rows, a query skips
all rows of its own id; fewer candidates than ``k`` give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BYTES = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)], dtype=np.uint8)


@dataclass
class Codes:
    """A learned code: centre, rotation, radius."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int

    def of(self, unit: np.ndarray) -> np.ndarray:
        """Codes of unit vectors, packed to bytes."""
        return np.packbits((unit - self.mean) @ self.turn > 0, axis=1)


def fit(sample: np.ndarray, k: int = 5, aim: float = 0.97, rounds: int = 30, seed: int = 42) -> Codes:
    """Learns rotation and radius from unit vectors (rows); the same rows give the same code."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    width = -(-d // 8) * 8
    mean = sample.mean(axis=0)
    _, _, axes = np.linalg.svd(sample - mean, full_matrices=True)
    z = (sample - mean) @ axes.T
    turns = []
    for _ in range(-(-width // d)):
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
            turn = (u @ v).T
        turns.append(axes.T @ turn)
    codes = Codes(mean, np.concatenate(turns, axis=1)[:, :width], width)
    packed = codes.of(sample)
    asked = np.arange(0, len(sample), max(1, len(sample) // 200))
    far = []
    for i in asked:
        near = sample @ sample[i]
        near[i] = -2
        far += [int(_BYTES[packed[i], packed[j]].sum()) for j in np.argsort(-near, kind="stable")[: min(k, len(sample) - 1)]]
    codes.radius = int(np.quantile(far, aim)) if far else width
    return codes


class Index:
    """Inverted lists of one shard: a list per byte substring and value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, group = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        members = np.argsort(group.reshape(-1), kind="stable")
        starts = np.searchsorted(group.reshape(-1)[members], np.arange(len(first)))
        self.ids = [np.sort(ids[m])[: k + 1] for m in np.split(members, starts[1:])]
        self.k, self.codes, self.vectors = k, codes, vectors[first]
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.packed = codes.of(self.vectors / self.norms[:, None])
        self.lists = []
        for column in self.packed.T:
            order = np.argsort(column, kind="stable")
            self.lists.append((order, np.searchsorted(column[order], np.arange(257))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Entries within ``radius`` bits: probe each list by the pigeonhole bound, then check whole codes."""
        reach, wider = divmod(radius + 1, len(self.lists))
        hit = np.zeros(len(self.packed), dtype=bool)
        for i, (value, (order, starts)) in enumerate(zip(code, self.lists)):
            near = np.flatnonzero(_BYTES[value] < reach + (i < wider))
            first, n = starts[near], starts[near + 1] - starts[near]
            hit[order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True  # all those lists at once
        found = np.flatnonzero(hit)
        return found[_BYTES[self.packed[found], code].sum(axis=1, dtype=np.int64) <= radius]

    def nearest(self, own: int, query: np.ndarray, code: np.ndarray) -> list[tuple[int, float]]:
        """The ``k`` nearest rows found, nearest first, ties to smaller ids."""
        radius, most = self.codes.radius, 8 * len(self.lists)
        while True:
            found = self.within(code, radius)
            if radius >= most or sum(int((self.ids[e] != own).sum()) for e in found[: 2 * self.k]) >= self.k:
                break
            radius = min(most, radius + 4)
        score = (self.vectors[found] * query).sum(axis=1) / (self.norms[found] * np.sqrt((query**2).sum()))
        if len(score) > 4 * self.k:
            cut = np.partition(-score, 2 * self.k)[2 * self.k]
            found, score = found[-score <= cut], score[-score <= cut]
        rows = [(int(i), float(s)) for e, s in zip(found, score) for i in self.ids[e] if i != own]
        return sorted(rows, key=lambda x: (-x[1], x[0]))[: self.k]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v: rows that take part, components as doubles."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & fine)


def neighbours(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 4_096, shard: int = 16_384, block: int = 8_192, aim: float = 0.97, seed: int = 42) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by ``every``, its ``k`` nearest found."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    facts = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.pmod("id", F.lit(every)) == 0).cast("long")).alias("q")).orderBy(F.desc("n"), "d").first()
    if facts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == facts["d"])
    share = min(1.0, 0.9 * sample_rows / facts["n"])
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy("id").limit(sample_rows).select("v").toPandas()["v"]
    sample = np.stack(drawn.to_numpy()).astype(float) if len(drawn) else np.array([rows.first()["v"]], dtype=float)
    codes = spark.sparkContext.broadcast(fit(sample / np.sqrt((sample**2).sum(axis=1, keepdims=True)), k, aim, seed=seed))
    shards, blocks = -(-facts["n"] // shard), max(1, -(-facts["q"] // block))
    base = rows.select(F.pmod(F.xxhash64("id", F.hash("v")), F.lit(shards)).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "id", "v")
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), "id", "v")

    def search(base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(base) and len(asked):
            index = Index(base["id"].to_numpy(np.int64), np.stack(base["v"].to_numpy()).astype(float), codes.value, k)
            queries = np.stack(asked["v"].to_numpy()).astype(float)
            packed = codes.value.of(queries / np.sqrt((queries**2).sum(axis=1, keepdims=True)))
            for own, query, code in zip(asked["id"].to_numpy(np.int64).tolist(), queries, packed):
                out += [(own, i, s) for i, s in index.nearest(own, query, code)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = base.groupBy("s", "b").cogroup(asked.groupBy("s", "b")).applyInPandas(search, "query_id long, vec_id long, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), F.col("vec_id").alias("i")))), 1, k)  # at most k rows a shard
    top = found.groupBy("query_id").agg(best.alias("top")).select("query_id", F.posexplode("top").alias("rank", "x"))
    return top.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.m")).alias("score"))
