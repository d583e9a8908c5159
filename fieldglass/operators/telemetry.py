"""Histories of metrics: trailing windows, series statistics, latest records.

Nulls and edges: rows without a time are in no window or range and are never latest unless all of a key are; a null key is a series; ties on time go to the largest tie-breaker; an
empty table gives an empty result; extra columns pass through filters and are dropped by aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trailing(df: DataFrame, at: str, days: int, as_of: str | None = None) -> DataFrame:
    """Rows strictly later than ``days`` before ``as_of`` (by default the latest time in the table, read first, so that the bound reaches the scan)."""
    end = F.lit(as_of).cast("timestamp_ntz") if as_of else F.lit(df.agg(F.max(at)).first()[0]).cast("timestamp_ntz")
    return df.filter(F.col(at).cast("timestamp_ntz") > end - F.make_dt_interval(F.lit(days)))


def date_range(df: DataFrame, at: str, first: str, last: str, key: str | None = None, values: Sequence[str] | None = None) -> DataFrame:
    """Rows between two dates, both taken at midnight and both included, of the named series."""
    out = df.filter(F.col(at).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))
    return out.filter(F.col(key).isin(list(values))) if key and values else out


def series_stats(df: DataFrame, keys: Sequence[str], metric: str, missing_as_zero: bool = True) -> DataFrame:
    """keys, n, avg, max, min of a metric; a missing value counts as 0 unless told otherwise."""
    m = F.coalesce(F.col(metric), F.lit(0.0)) if missing_as_zero else F.col(metric)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(m).alias("avg"), F.max(m).alias("max"), F.min(m).alias("min"))


def latest(df: DataFrame, keys: Sequence[str], at: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """The last row of each key (ties: the largest ``tie``), by an aggregate that combines before the shuffle."""
    picked = F.max_by(F.struct(at, tie, *[c for c in columns if c not in (at, tie)]), F.struct(at, tie)).alias("x")
    return df.groupBy(*keys).agg(picked).select(*keys, "x.*")
