"""Distribution drift between a reference and a current table.

Nulls and edges: NULL and NaN are left out; a category that is absent on one side counts 0 there; without rows on a side, shares and
the statistics that need them are NULL; repeated rows count each; columns not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.guards import clean, named, ratio
from fieldglass.functions.special import chi_square_p, kolmogorov_p
from fieldglass.functions.stages import settle


def ks(reference: DataFrame, current: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """n_reference, n_current, d, p_value, drifted: two-sample Kolmogorov-Smirnov.

    Rows are first reduced to counts per distinct value. The running counts have two levels, so no task orders all values: sampled
    ranges of values (``buckets`` of them, if given), and values within a range. NULL and NaN are left out.
    """
    cell = clean(reference).select(named(column).cast("double").alias("x"), F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(clean(current).select(named(column).cast("double").alias("x"), F.lit(0).alias("r"), F.lit(1).alias("c")))
    counts = cell.filter("x is not null").groupBy("x").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    placed = settle((counts.repartitionByRange(buckets, "x") if buckets else counts.repartitionByRange("x")).withColumn("b", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("b").agg(F.sum("r").alias("br"), F.sum("c").alias("bc"))  # a row a range
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("b", F.coalesce(F.sum("br").over(before), F.lit(0)).alias("r0"), F.coalesce(F.sum("bc").over(before), F.lit(0)).alias("c0"))
    sizes = totals.agg(F.sum("br").alias("nr"), F.sum("bc").alias("nc"))
    run = Window.partitionBy("b").orderBy("x")
    steps = placed.withColumn("r1", F.sum("r").over(run)).withColumn("c1", F.sum("c").over(run)).join(offsets, "b").crossJoin(sizes)
    gap = F.abs(ratio(F.col("r0") + F.col("r1"), F.col("nr")) - ratio(F.col("c0") + F.col("c1"), F.col("nc")))
    d = steps.agg(F.max("nr").alias("n_reference"), F.max("nc").alias("n_current"), F.max(gap).alias("d"))
    return d.withColumn("p_value", kolmogorov_p(F.col("d"), F.col("n_reference").cast("double"), F.col("n_current").cast("double"))).withColumn("drifted", F.col("p_value") < 0.05)


def category_counts(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """value, n_reference, n_current: full outer over the categories, 0 where absent."""
    r = reference.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_reference"))
    c = current.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_current"))
    return r.join(c, "value", "full").select("value", F.coalesce("n_reference", F.lit(0)).alias("n_reference"), F.coalesce("n_current", F.lit(0)).alias("n_current"))


def _shares(counts: DataFrame) -> DataFrame:
    totals = counts.agg(F.sum("n_reference").alias("tr"), F.sum("n_current").alias("tc"))
    return counts.crossJoin(totals).withColumn("share_reference", ratio(F.col("n_reference"), F.col("tr"))).withColumn("share_current", ratio(F.col("n_current"), F.col("tc")))


def chi_square(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """statistic, dof, reason: goodness of fit of the current counts to the reference rescaled to the same total."""
    cells = _shares(category_counts(reference, current, column))
    expected = F.col("share_reference") * F.col("tc")
    term = F.when(expected == 0, F.when(F.col("n_current") > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(F.try_divide(F.pow(F.col("n_current") - expected, 2), expected))
    return cells.agg(F.sum(term).alias("statistic"), (F.count(F.lit(1)) - 1).alias("dof"), F.when(F.count_if((expected == 0) & (F.col("n_current") > 0)) > 0, "new category").alias("reason"))


def chi_square_test(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    return chi_square(reference, current, column).withColumn("p_value", chi_square_p(F.col("statistic"), F.col("dof").cast("double"))).withColumn("drifted", F.col("p_value") < 0.05)


def category_shift(reference: DataFrame, current: DataFrame, column: str, top: int = 3) -> DataFrame:
    """value, shift (current minus reference share), total_variation of the column: the ``top`` largest shifts."""
    cells = _shares(category_counts(reference, current, column)).withColumn("shift", F.coalesce("share_current", F.lit(0.0)) - F.coalesce("share_reference", F.lit(0.0)))
    tvd = cells.agg((F.sum(F.abs("shift")) / 2).alias("total_variation"))
    return cells.select("value", "shift").crossJoin(tvd).orderBy(F.desc(F.abs("shift")), "value").limit(top)


def summary(reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """column_name, test, statistic, p_value, drifted for each column, and drift_score: drifted columns over all of the reference."""
    out = None
    for c in numeric:
        part = ks(reference, current, c).select(F.lit(c).alias("column_name"), F.lit("ks").alias("test"), F.col("d").alias("statistic"), "p_value", "drifted")
        out = part if out is None else out.unionByName(part)
    for c in categorical:
        part = chi_square_test(reference, current, c).select(F.lit(c).alias("column_name"), F.lit("chi_square").alias("test"), "statistic", "p_value", "drifted")
        out = part if out is None else out.unionByName(part)
    score = out.agg((F.count_if("drifted") / F.lit(len(reference.columns))).alias("drift_score"))
    return out.crossJoin(score)
