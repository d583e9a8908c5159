"""The batch profiles over streams: windowed counts with late data, and drift of a categorical column against a reference.

Nulls and edges: a value that is missing is counted as such by the profile and left out of categories; rows without a time are in no window; an empty
batch gives no window; repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.guards import clean


def windowed_profile(stream: DataFrame, at: str, column: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, n, n_missing, mean, min, max of a numeric column per event-time window; rows later than ``late`` are left out in streams."""
    seen = clean(stream).withColumn("fg_at", F.col(at).cast("timestamp")).withWatermark("fg_at", late)
    out = seen.groupBy(F.window("fg_at", window)).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(column)).alias("n_missing"), F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))
    return out.select(F.col("window.start").alias("start"), "n", "n_missing", "mean", "min", "max")


def windowed_categories(stream: DataFrame, at: str, column: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, value, n: counts of a categorical column per event-time window."""
    seen = stream.withColumn("fg_at", F.col(at).cast("timestamp")).withWatermark("fg_at", late).filter(F.col(column).isNotNull())
    return seen.groupBy(F.window("fg_at", window), F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "value", "n")


def batch_drift(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """start, total_variation of each window's shares against reference shares (value, share); for use in ``foreachBatch``.

    A category that a window lacks adds its reference share, which is what the seen ones leave of all shares; so no window is crossed with all categories.
    """
    expected = reference.select(F.col("value").alias("of"), F.col("share").alias("expected"))
    every = reference.agg(F.sum("share").alias("every"))
    both = counts.join(expected, F.col("value") == F.col("of"), "left").withColumn("expected", F.coalesce("expected", F.lit(0.0)))
    totals = counts.groupBy(F.col("start").alias("begin")).agg(F.sum("n").alias("total"))
    gap = F.abs(F.col("n") / F.col("total") - F.col("expected"))
    seen = both.join(totals, F.col("start") == F.col("begin")).groupBy("start").agg(F.sum(gap).alias("gap"), F.sum("expected").alias("seen"))
    return seen.crossJoin(every).select("start", ((F.col("gap") + F.col("every") - F.col("seen")) / 2).alias("total_variation"))
