"""Column helpers with one meaning of "missing" and no division errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(column: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def clean(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in float and double columns, so both count as missing everywhere."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.when(~F.isnan(named(c)), named(c)).alias(c) if c in floats else named(c) for c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; NULL where b is 0 or NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def one_row_to_long(row: DataFrame, columns: list[str], metrics: list[str]) -> DataFrame:
    """Turns a one-row table with columns ``metric__i`` into (column_name, metric...)."""
    cells = [x for i, c in enumerate(columns) for x in (F.lit(c), *[F.col(f"{m}__{i}") for m in metrics])]
    return row.select(F.stack(F.lit(len(columns)), *cells).alias("column_name", *metrics))
