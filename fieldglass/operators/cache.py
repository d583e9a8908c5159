"""Results by group that are computed again only where a group's rows have changed.

A cache is a folder. Each version adds the changed groups' fingerprints (``index``) and results (``data``) and counts once its
empty file in ``commits`` exists, which is created in one step; so readers see a whole version or none, a failed refresh leaves
nothing that counts, and of two refreshes at once the second fails. A group's fingerprint is its number of rows and two sums of hashes of
whole rows: they do not depend on the order of rows, are combined before the shuffle and never list a group's rows.

Nulls and edges: null keys are groups; a repeated row changes the fingerprint; a group that is gone from the table is gone from the
result; an unchanged table writes nothing; an empty table has an empty result; columns count in the table's order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.functions.stages import mark, names_in


@dataclass
class Refresh:
    """The whole result (keys, values, ``version`` that computed it), the version now current, and how many groups were computed and dropped for it."""

    result: DataFrame
    version: int
    n_computed: int
    n_removed: int


def fingerprints(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_rows, mark_a, mark_b: what a group's rows are, whatever their order."""
    whole = [F.to_json(F.struct("*"))] if any(t.startswith("map") for _, t in df.dtypes) else [F.struct("*")]
    hashes = lambda salt: F.xxhash64(F.lit(salt), *whole).cast("decimal(20,0)")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(hashes(1)).alias("mark_a"), F.sum(hashes(2)).alias("mark_b"))


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def _index(spark: SparkSession, path: str, versions: list[int], keys: Sequence[str]) -> DataFrame:
    """The live groups: of each the last version that changed it."""
    every = spark.read.parquet(*[f"{path}/index/{v}" for v in versions])
    last = Window.partitionBy(*keys).orderBy(F.desc("version"))  # a row a version that changed the group
    return every.withColumn("newest_", F.row_number().over(last)).filter("newest_ = 1 and not gone").drop("newest_", "gone")


def _result(spark: SparkSession, path: str, versions: list[int], keys: Sequence[str]) -> DataFrame:
    data = spark.read.parquet(*[f"{path}/data/{v}" for v in versions])
    live = _index(spark, path, versions, keys).select(*keys, "version")
    return data.join(live, _same(data, live, [*keys, "version"]), "left_semi")


def refresh(df: DataFrame, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame], path: str) -> Refresh:
    """Brings the cache in ``path`` up to date with ``df``. ``compute`` maps rows to one row (or more) a group, with the columns ``keys`` among them."""
    spark, keys = df.sparkSession, list(keys)
    versions = [int(v) for v in names_in(spark, f"{path}/commits")]
    version = max(versions, default=0) + 1
    fresh = fingerprints(df, keys)
    marks = [*keys, "n_rows", "mark_a", "mark_b"]
    changed = fresh.select(*marks, F.lit(version).alias("version"), F.lit(False).alias("gone"))
    if versions:
        old = _index(spark, path, versions, keys)
        gone = old.join(fresh, _same(old, fresh, keys), "left_anti").select(*marks, F.lit(version).alias("version"), F.lit(True).alias("gone"))
        changed = changed.join(old, _same(changed, old, marks), "left_anti").unionByName(gone)
    changed.write.mode("overwrite").parquet(f"{path}/index/{version}")  # overwrites what a failed refresh left
    written = spark.read.parquet(f"{path}/index/{version}")
    n = {r["gone"]: r["n"] for r in written.groupBy("gone").agg(F.count(F.lit(1)).alias("n")).collect()}
    if versions and not n:
        return Refresh(_result(spark, path, versions, keys), versions[-1], 0, 0)
    stale = written.filter("not gone").select(*keys)
    todo = df.join(stale, _same(df, stale, keys), "left_semi")
    compute(todo).withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/data/{version}")
    if not mark(spark, f"{path}/commits/{version:012d}"):
        raise RuntimeError(f"version {version} of {path} was written by someone else")
    return Refresh(_result(spark, path, [*versions, version], keys), version, n.get(False, 0), n.get(True, 0))
