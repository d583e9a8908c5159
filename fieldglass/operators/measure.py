"""Statistics of run-time and memory measurements, outlier flags, and the complexity class that fits them.

Nulls and edges, unless a function says otherwise: null measurements are left out and a group without any has null statistics; a null key is a group of its
own; repeated rows are measurements of their own; an empty table gives an empty result; extra columns are ignored. Medians and
percentiles are exact and come from :mod:`fieldglass.operators.quantile`, which holds no group's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.guards import ratio
from fieldglass.operators.quantile import with_quantiles

#: Complexity classes from the cheapest to the dearest, each with its growth as SQL over n.
CLASSES = [("O(1)", "1.0D"), ("O(log n)", "ln(n)"), ("O(n)", "n"), ("O(n log n)", "n * ln(n)"), ("O(n^2)", "n * n"), ("O(n^3)", "n * n * n"), ("O(2^n)", "pow(2.0D, n)")]


def stats(df: DataFrame, keys: Sequence[str], value: str, with_cv: bool = True) -> DataFrame:
    """keys, n, min, max, mean, median, stdev, variance (sample; 0 for fewer than two), cv."""
    v = F.col(value)
    zero = lambda c: F.when(F.count(v) > 1, c).otherwise(F.lit(0.0))
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), zero(F.stddev_samp(v)).alias("stdev"), zero(F.var_samp(v)).alias("variance"))
    out = with_quantiles(out, df, keys, v, [0.5], ["median"]).select(*keys, "n", "min", "max", "mean", "median", "stdev", "variance")
    return out.withColumn("cv", F.coalesce(ratio(F.col("stdev"), F.col("mean")), F.lit(0.0))) if with_cv else out


def percentiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float] = (0.9, 0.95, 0.99)) -> DataFrame:
    """keys, mean, std (population), min, max and one column ``p90``... per percentile."""
    v = F.col(value)
    out = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return with_quantiles(out, df, keys, v, at, [f"p{round(100 * x)}" for x in at])


def batch_stats(df: DataFrame, size: str, seconds: str) -> DataFrame:
    """size, mean, std (population), min, max, throughput = size / mean."""
    s = F.col(seconds)
    out = df.groupBy(F.col(size).alias("size")).agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"))
    return out.withColumn("throughput", ratio(F.col("size"), F.col("mean")))


def outlier_flags(df: DataFrame, keys: Sequence[str], value: str, method: str = "iqr", k: float = 1.5) -> DataFrame:
    """Adds ``is_outlier`` by interquartile range or z-score within each group (strict; none in groups of fewer than 4 or without spread)."""
    v = F.col(value)
    groups = [f"g_{c}" for c in keys]
    facts = df.groupBy(*[F.col(c).alias(g) for c, g in zip(keys, groups)]).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_pop(v).alias("s"))
    if method == "iqr":
        facts = with_quantiles(facts, df.select(*[F.col(c).alias(g) for c, g in zip(keys, groups)], v.alias("v_")), groups, F.col("v_"), [0.25, 0.75], ["q1", "q3"])
    joined = df.join(facts, [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in keys])
    if method == "iqr":
        spread = F.col("q3") - F.col("q1")
        flag = (v < F.col("q1") - k * spread) | (v > F.col("q3") + k * spread)
    else:
        flag = (F.col("s") > 0) & (F.abs(v - F.col("m")) > k * F.col("s"))
    return joined.withColumn("is_outlier", (F.col("n") >= 4) & F.coalesce(flag, F.lit(False))).select(*df.columns, "is_outlier")


def outlier_share(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, n_outliers, outlier_percent."""
    out = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_outlier").alias("n_outliers"))
    return out.withColumn("outlier_percent", F.coalesce(ratio(F.col("n_outliers"), F.col("n")) * 100, F.lit(0.0)))


def early_stop(df: DataFrame, keys: Sequence[str], size: str, trial: str, value: str, timeout: float) -> DataFrame:
    """The trials that run when everything after the first one over ``timeout`` is skipped."""
    earlier = Window.partitionBy(*keys).orderBy(size, trial).rowsBetween(Window.unboundedPreceding, -1)
    over = F.max((F.col(value) > timeout).cast("int")).over(earlier)
    return df.withColumn("stopped", F.coalesce(over, F.lit(0))).filter("stopped = 0").drop("stopped")


def complexity_fits(df: DataFrame, keys: Sequence[str], size: str, value: str) -> DataFrame:
    """keys, complexity, slope, intercept, r2, rank: least squares of value on each class's growth; classes that overflow are dropped."""
    n = F.col(size).cast("double")
    points = df.filter(n.isNotNull() & F.col(value).isNotNull()).select(*keys, n.alias("n"), F.col(value).cast("double").alias("y"))
    parts = ", ".join(f"{i}, '{name}', {expr}" for i, (name, expr) in enumerate(CLASSES))
    long = points.filter("n > 0").selectExpr(*keys, "y", f"stack({len(CLASSES)}, {parts}) as (pos, complexity, x)")
    x, y = F.col("x"), F.col("y")
    fits = long.groupBy(*keys, "pos", "complexity").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.min(y).alias("ly"), F.max(y).alias("hy"), F.avg(y).alias("my"), F.min(x).alias("lx"), F.max(x).alias("mx"), F.count(F.lit(1)).alias("points"))
    fits = fits.filter((F.col("points") >= 3) & (F.col("mx") < float("inf")))
    # equal values are told by their ends: the variance of equal values from several tasks may come out above 0
    line = lambda c, flat: F.when((F.col("ly") == F.col("hy")) | (F.col("lx") == F.col("mx")), flat).otherwise(F.coalesce(F.col(c), flat)).alias(c)
    fits = fits.select(*keys, "pos", "complexity", line("slope", F.lit(0.0)), line("intercept", F.col("my")), line("r2", F.lit(0.0)))
    best = Window.partitionBy(*keys).orderBy(F.desc(F.round("r2", 12)), "pos")
    return fits.withColumn("rank", F.row_number().over(best)).drop("pos")


def best_complexity(df: DataFrame, keys: Sequence[str], size: str, value: str) -> DataFrame:
    """keys, complexity, quality (r2); Unknown for fewer than three points."""
    groups = df.select(*keys).distinct()
    best = complexity_fits(df, keys, size, value).filter("rank = 1").select(*keys, "complexity", F.col("r2").alias("quality"))
    return groups.join(best, list(keys), "left").select(*keys, F.coalesce("complexity", F.lit("Unknown")).alias("complexity"), F.coalesce("quality", F.lit(0.0)).alias("quality"))


def highest_complexity(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, complexity: the dearest class mentioned in any text of the group."""
    rank = F.greatest(*[F.when(F.contains(F.col(text), F.lit(name)), i).otherwise(-1) for i, (name, _) in enumerate(CLASSES)])
    names = F.array(*[F.lit(name) for name, _ in CLASSES])
    out = df.groupBy(*keys).agg(F.max(rank).alias("r"))
    return out.select(*keys, F.when(F.col("r") >= 0, F.element_at(names, F.greatest(F.col("r"), F.lit(0)) + 1)).otherwise("Unknown").alias("complexity"))


def robust_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, median, mad, robust_cv = 1.4826 * mad / median."""
    v, groups = F.col(value).cast("double"), [f"g_{k}" for k in keys]
    every = df.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)]).distinct()
    med = with_quantiles(every, df.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], v.alias("v_")), groups, F.col("v_"), [0.5], ["median"])
    joined = df.select(*keys, v.alias("v_")).join(med, [F.col(k).eqNullSafe(F.col(f"g_{k}")) for k in keys])
    out = joined.groupBy(*keys).agg(F.max("median").alias("median"))
    out = with_quantiles(out, joined.select(*keys, F.abs(F.col("v_") - F.col("median")).alias("away_")), keys, F.col("away_"), [0.5], ["mad"])
    return out.withColumn("robust_cv", ratio(F.col("mad") * 1.4826, F.col("median")))


#: Weights of fit, low spread and plausible slope in the quality of a memory fit; the least growth that counts.
FIT_WEIGHT, SPREAD_WEIGHT, SLOPE_WEIGHT, LEAST_GROWTH = 0.4, 0.3, 0.3, 1e-6


def memory_scaling(df: DataFrame, keys: Sequence[str], size: str, used: str, baseline: Column | float = 0.0) -> DataFrame:
    """keys, per_sample (median of growth over the baseline, per unit of size), spread (its robust CV), slope, r2, quality.

    Growth that is linear in size has quality 1: a blend of the line's fit, the spread of the growth per unit, and how far the line's slope is from
    the median growth per unit. Rows without a positive size or a measurement are left out; growth below the least counts as the least.
    """
    base = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
    x = F.col(size).cast("double")
    grown = df.filter(F.col(used).isNotNull()).select(*keys, x.alias("x_"), F.greatest(F.col(used).cast("double") - base, F.lit(LEAST_GROWTH)).alias("y_")).filter("x_ > 0")
    middle = robust_stats(grown.withColumn("each_", F.col("y_") / F.col("x_")), keys, "each_")
    line = grown.groupBy(*[F.col(k).alias(f"l_{k}") for k in keys]).agg(F.regr_slope("y_", "x_").alias("slope"), F.regr_sxx("y_", "x_").alias("sxx"), F.regr_sxy("y_", "x_").alias("sxy"), F.regr_syy("y_", "x_").alias("syy"))
    both = middle.join(line, [F.col(k).eqNullSafe(F.col(f"l_{k}")) for k in keys]) if keys else middle.crossJoin(line)
    spread = F.col("mad") * 1.4826 / (F.col("median") + 1e-6)
    r2 = 1 - (F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("syy") + 1e-10)
    plausible = 1 - F.least(F.abs(F.col("slope") - F.col("median")) / (F.col("median") + 1e-10), F.lit(1.0))
    quality = FIT_WEIGHT * F.greatest(r2, F.lit(0.0)) + SPREAD_WEIGHT / (1 + spread) + SLOPE_WEIGHT * plausible
    return both.select(*keys, F.col("median").alias("per_sample"), spread.alias("spread"), "slope", r2.alias("r2"), quality.alias("quality"))


def deltas(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Adds ``delta_s``: seconds since the row before in the group."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    w = Window.partitionBy(*keys).orderBy(at)
    return df.withColumn("delta_s", seconds(F.col(at)) - seconds(F.lag(at).over(w)))


def weighted_efficiency(df: DataFrame, efficiency: Column, seconds: Column, vectorized: Column) -> DataFrame:
    """efficiency: time-weighted over the vectorized operations; 0 without any."""
    return df.agg(F.coalesce(ratio(F.sum(F.when(vectorized, efficiency * seconds)), F.sum(F.when(vectorized, seconds))), F.lit(0.0)).alias("efficiency"))


def speedups(df: DataFrame, keys: Sequence[str], seconds: str) -> DataFrame:
    """Adds ``relative_speed``: the group's least time over this time."""
    return df.withColumn("relative_speed", ratio(F.min(seconds).over(Window.partitionBy(*keys)), F.col(seconds)))


def scaling_efficiency(df: DataFrame, devices: str, throughput: str) -> DataFrame:
    """Adds ``efficiency`` = throughput / (throughput of one device * devices); the single-device row is one row, so it joins as such."""
    single = df.filter(F.col(devices) == 1).agg(F.max(throughput).alias("single"))
    return df.crossJoin(single).withColumn("efficiency", ratio(F.col(throughput), F.col("single") * F.col(devices))).drop("single")
