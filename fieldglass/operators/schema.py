"""Schema expectations and schema drift, as rows.

Nulls and edges: NULL and NaN are never out of range or outside a list; an empty table has no violations of values, only of columns; an empty list of rules finds every column unexpected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.guards import clean, named

RULES = "column_name string, type string, min double, max double, categories array<string>"


def columns_of(df: DataFrame) -> DataFrame:
    """column_name, type: metadata only."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "column_name string, type string")


def schema_drift(current: DataFrame, reference: DataFrame) -> DataFrame:
    """change (added, removed, type_changed), column_name, reference_type, current_type."""
    c, r = columns_of(current).withColumnRenamed("type", "current_type"), columns_of(reference).withColumnRenamed("type", "reference_type")
    both = r.join(c, "column_name", "full")
    change = F.when(F.col("reference_type").isNull(), "added").when(F.col("current_type").isNull(), "removed").when(F.col("reference_type") != F.col("current_type"), "type_changed")
    return both.withColumn("change", change).filter("change is not null").select("change", "column_name", "reference_type", "current_type")


def validate(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """column_name, issue, detail: missing and extra columns, wrong kinds, values outside a range or a category list.

    ``rules``: (column, type ``numeric`` or ``categorical``, min, max, categories). All value checks share one aggregate.
    """
    df, spark = clean(df), df.sparkSession
    actual = {f.name: f.dataType for f in df.schema}
    found = [(r[0], "missing", None) for r in rules if r[0] not in actual] + [(c, "unexpected", None) for c in actual if c not in {r[0] for r in rules}]
    checks, meta = [], []
    for name, kind, low, high, categories in (r for r in rules if r[0] in actual):
        numeric = isinstance(actual[name], T.NumericType)
        if kind == "numeric" and not numeric or kind == "categorical" and not isinstance(actual[name], (T.StringType, T.BooleanType)):
            found.append((name, "wrong_type", actual[name].simpleString()))
            continue
        if kind == "numeric":
            checks.append(F.struct(F.min(named(name)).cast("double").alias("lo"), F.max(named(name)).cast("double").alias("hi")))
        else:
            checks.append(F.array_sort(F.collect_set(F.when(~named(name).isin(list(categories or [])), named(name)))))
        meta.append((name, kind, low, high))
    values = df.agg(F.lit(0), *checks).first()[1:] if checks else []
    for (name, kind, low, high), v in zip(meta, values):
        if kind == "numeric":
            if low is not None and v["lo"] is not None and v["lo"] < low:
                found.append((name, "below_min", repr(float(v["lo"]))))
            if high is not None and v["hi"] is not None and v["hi"] > high:
                found.append((name, "above_max", repr(float(v["hi"]))))
        else:
            found += [(name, "invalid_category", x) for x in v]
    return spark.createDataFrame(found, "column_name string, issue string, detail string")


def invalid_categories(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """value, n: values outside the allowed list (an anti join in spirit; the list is a literal)."""
    return df.filter(named(column).isNotNull() & ~named(column).isin(allowed)).groupBy(named(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
