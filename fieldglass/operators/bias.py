"""How a protected attribute and a target are distributed.

Nulls and edges: rows without the attribute or the target are left out; a group without a target has no row; an empty table gives an empty result, or one row of NULLs for the
gap; repeated rows count each; column names may hold any characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.guards import named, ratio
from fieldglass.operators.profile import value_distribution

distribution = value_distribution


def target_by_group(df: DataFrame, attribute: str, target: str) -> DataFrame:
    """attribute, target_value, value: the mean of a double, float or boolean target (target_value NULL), else each class's share in the group."""
    known = df.filter(named(attribute).isNotNull() & named(target).isNotNull())
    if dict(df.dtypes)[target] in ("double", "float", "boolean"):
        return known.groupBy(named(attribute).alias("attribute")).agg(F.lit(None).cast("string").alias("target_value"), F.avg(named(target).cast("double")).alias("value"))
    cells = known.groupBy(named(attribute).alias("attribute"), named(target).cast("string").alias("target_value")).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("attribute").agg(F.sum("n").alias("total"))
    return cells.join(totals, "attribute").select("attribute", "target_value", ratio(F.col("n"), F.col("total")).alias("value"))


def parity_gap(df: DataFrame, attribute: str, target: str) -> DataFrame:
    """min_rate, max_rate, parity_gap of a binary target over the non-null groups (labels, not predictions)."""
    rates = df.filter(named(attribute).isNotNull()).groupBy(named(attribute)).agg(F.avg(named(target).cast("double")).alias("rate")).filter("rate is not null")
    return rates.agg(F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"), (F.max("rate") - F.min("rate")).alias("parity_gap"))
