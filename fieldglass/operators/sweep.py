"""Peaks of what is alive at one time: buffers, activations, goods on their way. A sweep over interval ends with running sums in two levels.

Changes of one group at one moment are added up first. The changes are split by sampled ranges of (group, moment); sums of whole ranges
give each range's start level, and running sums within a range the rest. So a group with most of all rows is spread over many
tasks, and no task orders it all.

Nulls and edges: an interval without a start or weight is left out, one without an end never ends, one that ends at or before its
start is never alive; at one moment ends come before starts; a null key is a group; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.stages import settle


def changes(df: DataFrame, keys: Sequence[str], start: Column, end: Column, weight: Column) -> DataFrame:
    """keys, at, delta: one row a moment of a group at which the level may change."""
    alive = df.select(*keys, start.alias("s_"), end.alias("e_"), weight.alias("w_")).filter("s_ is not null and w_ is not null and (e_ is null or e_ > s_)")
    ends = F.array(F.struct(F.col("s_").alias("at"), F.col("w_").alias("delta")), F.struct(F.col("e_").alias("at"), (-F.col("w_")).alias("delta")))
    return alive.select(*keys, F.inline(ends)).filter("at is not null").groupBy(*keys, "at").agg(F.sum("delta").alias("delta"))


def levels(moves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, at, alive: the level from each moment on."""
    ranged = settle(moves.repartitionByRange(*keys, "at").withColumn("range_", F.spark_partition_id()), "moves")
    # one row a range and group in it
    whole = ranged.groupBy(*keys, "range_").agg(F.sum("delta").alias("sum_"))
    before = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    begun = whole.select(*[F.col(k).alias(f"on_{i}") for i, k in enumerate(keys)], F.col("range_").alias("in_"), F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("begun_"))
    same = F.col("range_") == F.col("in_")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"on_{i}"))
    run = Window.partitionBy("range_", *keys).orderBy("at")
    return ranged.withColumn("run_", F.sum("delta").over(run)).join(begun, same).select(*keys, "at", (F.col("begun_") + F.col("run_")).alias("alive"))


def peaks(df: DataFrame, keys: Sequence[str], start: Column, end: Column, weight: Column) -> DataFrame:
    """keys, peak, peak_at (the first moment of the peak), n_moments: one row a group that has an interval."""
    level = levels(changes(df, keys, start, end, weight), keys)
    return level.groupBy(*keys).agg(F.max("alive").alias("peak"), F.max(F.struct("alive", (-F.unix_micros(F.col("at").cast("timestamp"))).alias("early"), "at"))["at"].alias("peak_at"), F.count(F.lit(1)).alias("n_moments"))
