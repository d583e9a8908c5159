"""Profiles of a table: counts, completeness, uniqueness, outliers, correlation, feature types.

Nulls and edges, unless a function says otherwise: NULL and NaN are missing; an empty table has counts of 0 and NULL shares; a column without a
value has no quantiles, so no outliers; repeated rows count as rows; column names may hold any characters. Results have one row a column or a value.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.guards import clean, named, numeric_columns, one_row_to_long, ratio, string_columns
from fieldglass.operators.quantile import exact_quantiles

#: Scales whose words make a text column ordinal.
ORDINAL_SETS = [("low", "medium", "high"), ("small", "medium", "large"), ("poor", "fair", "good", "excellent"), ("never", "rarely", "sometimes", "often", "always"), ("strongly disagree", "disagree", "neutral", "agree", "strongly agree")]
DATE_LIKE = r"^\d{2,4}[-/]\d{1,2}[-/]\d{1,2}"


def basic_profile(df: DataFrame) -> DataFrame:
    """row_count, column_count."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)).cast("long"))


def completeness(df: DataFrame) -> DataFrame:
    """column_name, n_rows, n_missing, completeness (percent): one pass over all columns."""
    df, cols = clean(df), df.columns
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(named(c)).alias(f"v__{i}") for i, c in enumerate(cols)])
    long = one.select("n", F.stack(F.lit(len(cols)), *[x for i, c in enumerate(cols) for x in (F.lit(c), F.col(f"v__{i}"))]).alias("column_name", "v"))
    return long.select("column_name", F.col("n").alias("n_rows"), (F.col("n") - F.col("v")).alias("n_missing"), (ratio(F.col("v"), F.col("n")) * 100).alias("completeness"))


def _kind(kind: T.DataType) -> str | None:
    """The common type in which values of a column keep their equality; None: a type of its own."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "long"
    return {T.FloatType: "double", T.DoubleType: "double", T.StringType: "string"}.get(type(kind))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, n_distinct of the non-null values: columns of one kind share a scan and a shuffle of (column, value), each pair once a task."""
    kinds: dict[str, list[str]] = {}
    for c in columns:
        kind = _kind(df.schema[c].dataType)
        kinds.setdefault(kind or f"own {c}", []).append(c)
    parts = []
    for kind, cols in kinds.items():
        value = lambda c: named(c) if kind.startswith("own") else named(c).cast(kind)  # noqa: E731,B023
        pairs = df.select(F.stack(F.lit(len(cols)), *[x for c in cols for x in (F.lit(c), value(c))]).alias("column_name", "v"))
        parts.append(pairs.filter("v is not null").distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n")))
    found = functools.reduce(DataFrame.unionByName, parts).withColumnRenamed("column_name", "found")
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return every.join(found, F.col("column_name") == F.col("found"), "left").select("column_name", F.coalesce("n", F.lit(0)).cast("long").alias("n_distinct"))


def uniqueness(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column_name, n_distinct, uniqueness (percent of all rows; NULL for an empty table).

    ``approximate`` keeps one sketch a column, in one pass.
    """
    df, cols = clean(df), df.columns
    n = df.agg(F.count(F.lit(1)).alias("n"))
    if approximate:
        one = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(named(c)).alias(f"d__{i}") for i, c in enumerate(cols)])
        counts = one_row_to_long(one, cols, ["d"]).select("column_name", F.col("d").alias("n_distinct"))
    else:
        counts = distinct_counts(df, cols)
    return counts.crossJoin(n).select("column_name", "n_distinct", (ratio(F.col("n_distinct"), F.col("n")) * 100).alias("uniqueness"))


def missing(df: DataFrame) -> DataFrame:
    """column_name, n_missing, and the table's total under the name ``*``."""
    per = completeness(df).select("column_name", "n_missing")
    return per.unionByName(per.agg(F.sum("n_missing").alias("n_missing")).select(F.lit("*").alias("column_name"), "n_missing"))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """value, n, share of the non-null values."""
    counts = clean(df).filter(named(column).isNotNull()).groupBy(named(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("value", "n", ratio(F.col("n"), F.col("total")).alias("share"))


def duplicates(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """n_groups, n_surplus: repeated keys (all columns if none are named) and rows beyond the first of each."""
    groups = df.groupBy(*[named(c) for c in keys or df.columns]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_surplus"))


def quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float] = (0.25, 0.75)) -> DataFrame:
    """column_name, q0, q1, ...: exact quantiles with linear interpolation; null for a column without a value. All columns are selected from at once, in rounds."""
    columns = list(columns)
    every = df.sparkSession.createDataFrame(list(enumerate(columns)), "place int, column_name string")
    long = df.select(F.stack(F.lit(max(1, len(columns))), *[x for i, c in enumerate(columns) for x in (F.lit(i), named(c).cast("double"))] or [F.lit(0), F.lit(None).cast("double")]).alias("found", "v"))
    found = exact_quantiles(long, ["found"], F.col("v"), at)
    return every.join(found, F.col("place") == F.col("found"), "left").select("column_name", *[f"q{k}" for k in range(len(at))])


def outlier_bounds(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """column_name, q1, q3, lower, upper."""
    q = quantiles(df, columns or numeric_columns(df)).select("column_name", F.col("q0").alias("q1"), F.col("q1").alias("q3"))
    spread = F.col("q3") - F.col("q1")
    return q.select("column_name", "q1", "q3", (F.col("q1") - k * spread).alias("lower"), (F.col("q3") + k * spread).alias("upper"))


def _outside(bound) -> Column:
    """Whether the bound's column lies strictly outside; never, if the column has no quartiles."""
    c = named(bound["column_name"])
    return F.lit(False) if bound["lower"] is None else (c < bound["lower"]) | (c > bound["upper"])


def outlier_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """column_name, keys, value: values strictly outside the bounds, in one scan. The bounds (two numbers a column) become literals, so they reach the scan."""
    bounds = outlier_bounds(df, list(columns or numeric_columns(df)), k).collect()
    df = clean(df)
    found = [F.when(_outside(b), F.struct(F.lit(b["column_name"]).alias("column_name"), named(b["column_name"]).cast("double").alias("value"))) for b in bounds]
    any_outside = functools.reduce(lambda a, b: a | b, [_outside(b) for b in bounds], F.lit(False))
    hits = df.filter(any_outside).select(*[named(c) for c in keys], F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("hit_"))
    return hits.select("hit_.column_name", *[named(c) for c in keys], "hit_.value")


def outlier_counts(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """column_name, n_outliers for every numeric column: one pass."""
    columns = list(columns or numeric_columns(df))
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, n_outliers long")
    bounds = outlier_bounds(df, columns, k).collect()
    one = clean(df).agg(*[F.count_if(_outside(b)).alias(f"n_outliers__{i}") for i, b in enumerate(bounds)])
    return one_row_to_long(one, [b["column_name"] for b in bounds], ["n_outliers"])


def _pearsons(df: DataFrame, pairs: list[tuple[str, str]]) -> list[Column]:
    """Correlations as plain sums over columns shifted by their mean (a first pass), which stay exact for large offsets and cheap to compile.

    Columns without missing values share their sums between pairs; a pair with missing values has sums over its complete rows.
    """
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    facts = df.agg(F.count(F.lit(1)), *[x for c in cols for x in (F.avg(named(c).cast("double")), F.count(named(c)), F.max(F.abs(named(c).cast("double"))))]).first()
    mean, whole, most = ({c: facts[1 + 3 * i + k] for i, c in enumerate(cols)} for k in range(3))
    out = []
    for a, b in pairs:
        if mean[a] is None or mean[b] is None:
            out.append(F.max(F.lit(None).cast("double")))
            continue
        x, y = (named(c).cast("double") - F.lit(mean[c]) for c in (a, b))
        if whole[a] < facts[0] or whole[b] < facts[0]:
            both = named(a).isNotNull() & named(b).isNotNull()
            x, y = F.when(both, x), F.when(both, y)
        n = F.count(x)
        var = lambda v, c: F.sum(v * v) - F.sum(v) * F.sum(v) / n  # noqa: E731,B023
        flat = lambda v, c: var(v, c) <= n * (1e-13 * most[c]) ** 2  # noqa: E731,B023
        r = (F.sum(x * y) - F.sum(x) * F.sum(y) / n) / F.sqrt(var(x, a) * var(y, b))
        out.append(F.when((n > 0) & ~flat(x, a) & ~flat(y, b), r))
    return out


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_a, column_b, r: the full matrix, all pairs in one aggregate; no row with fewer than two numeric columns."""
    df = clean(df)
    cols = list(columns or numeric_columns(df))
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, r double")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[r.alias(f"r{i}") for i, r in enumerate(_pearsons(df, pairs))])
    half = one.select(F.stack(F.lit(len(pairs)), *[x for i, (a, b) in enumerate(pairs) for x in (F.lit(a), F.lit(b), F.col(f"r{i}"))]).alias("column_a", "column_b", "r"))
    other = half.filter("column_a <> column_b").select(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "r")
    return half.unionByName(other)


def strong_correlation(matrix: DataFrame, above: float = 0.7, top: int = 10) -> DataFrame:
    """The pairs (in both orders) with the largest absolute correlation over ``above``."""
    return matrix.filter((F.col("column_a") != F.col("column_b")) & (F.abs("r") > above)).orderBy(F.desc(F.abs("r")), "column_a", "column_b").limit(top)


def feature_types(df: DataFrame) -> DataFrame:
    """column_name, feature_type: numeric, binary, datetime, categorical, ordinal or text. One aggregate over all rows; no sampling."""
    df = clean(df)
    distinct = {r["column_name"]: r for r in uniqueness(df).collect()}  # a row a column
    n = df.count()
    strings = string_columns(df)
    facts = df.agg(F.lit(0), *[F.avg(named(c).rlike(DATE_LIKE).cast("int")).alias(f"d__{i}") for i, c in enumerate(strings)]).first()
    few = [c for c in strings if 0 < distinct[c]["n_distinct"] <= 100]
    words = df.agg(F.lit(0), *[F.collect_set(F.lower(named(c))).alias(f"w__{i}") for i, c in enumerate(few)]).first()  # at most 100 values a column
    rows = []
    for f in df.schema:
        d = distinct[f.name]["n_distinct"]
        if isinstance(f.dataType, T.NumericType):
            kind = "binary" if d <= 2 else "numeric"
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kind = "datetime"
        elif isinstance(f.dataType, T.BooleanType):
            kind = "binary"
        elif isinstance(f.dataType, T.StringType):
            if (facts[f"d__{strings.index(f.name)}"] or 0) > 0.7:
                kind = "datetime"
            elif d <= 10 or (d / n < 0.05 and d <= 100):
                kind = "categorical"
            else:
                seen = set(words[f"w__{few.index(f.name)}"]) if f.name in few else set()
                kind = "ordinal" if any(len(seen & set(s)) >= 0.7 * len(s) for s in ORDINAL_SETS) else "text"
        else:
            kind = "text"
        rows.append((f.name, kind))
    return df.sparkSession.createDataFrame(rows, "column_name string, feature_type string")


def profile(df: DataFrame) -> DataFrame:
    """column_name, completeness, uniqueness, n_outliers (NULL for non-numeric columns)."""
    out = completeness(df).select("column_name", "completeness").join(uniqueness(df).select("column_name", "uniqueness"), "column_name")
    return out.join(outlier_counts(df).withColumn("n_outliers", F.col("n_outliers").cast("double")), "column_name", "left")
