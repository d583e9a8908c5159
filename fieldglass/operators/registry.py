"""Append-only registries: the current state is a query over the events.

Nulls and edges: a null key is a key; events without a time come before all others; ties go to the later sequence number or the larger version; repeated events change nothing; an
empty registry has no current state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("staging", "production")


def current(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last event of each key: an upsert as append plus latest row."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def promote(promotions: DataFrame, row: DataFrame) -> DataFrame:
    """Appends promotions; a stage other than staging or production is an error."""
    checked = row.withColumn("stage", F.when(F.col("stage").isin(*STAGES), F.col("stage")).otherwise(F.raise_error(F.concat(F.lit("unknown stage: "), F.coalesce("stage", F.lit("null"))))))
    return promotions.unionByName(checked)


def pointers(promotions: DataFrame) -> DataFrame:
    """model, stage, version: the last promotion to each stage (ties: the later sequence number)."""
    return promotions.groupBy("model", "stage").agg(F.max_by("version", F.struct("promoted_at", "seq")).alias("version"))


def status(promotions: DataFrame) -> DataFrame:
    """model, version, status: the last stage each version was given."""
    return promotions.groupBy("model", "version").agg(F.max_by("stage", F.struct("promoted_at", "seq")).alias("status"))


def latest_version(versions: DataFrame) -> DataFrame:
    """model, version: the last registered, whatever its number."""
    return versions.groupBy("model").agg(F.max_by("version", F.struct("created_at", "version")).alias("version"))


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """metric, v1, v2, diff, pct_change: full outer over the metrics; a first value of 0 makes the change infinite."""
    both = first.select("metric", F.col("value").alias("v1")).join(second.select("metric", F.col("value").alias("v2")), "metric", "full")
    diff = F.col("v2") - F.col("v1")
    pct = F.when(diff.isNotNull(), F.when(F.col("v1") == 0, F.lit(float("inf"))).otherwise(F.try_divide(diff, F.col("v1")) * 100))
    return both.select("metric", "v1", "v2", diff.alias("diff"), pct.alias("pct_change"))


def merge_metadata(base: DataFrame, update: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Shallow merge of maps: entries of the update win."""
    new = update.select(*keys, F.col(column).alias("new"))
    both = base.join(new, list(keys), "left")
    kept = F.map_filter(column, lambda k, _: ~F.coalesce(F.map_contains_key("new", k), F.lit(False)))
    return both.withColumn(column, F.map_concat(kept, F.coalesce("new", F.create_map().cast("map<string,string>")))).drop("new")


def flatten_metrics(runs: DataFrame, keys: Sequence[str], column: str, prefix: str) -> DataFrame:
    """keys, metric, value: one row per entry of a map, named ``prefix.key``."""
    return runs.select(*keys, F.explode(column).alias("key", "value")).select(*keys, F.concat_ws(".", F.lit(prefix), "key").alias("metric"), "value")


def suggestion_filter(df: DataFrame, category: str | None = None, min_priority: int | None = None, min_confidence: float | None = None) -> DataFrame:
    """Suggestions that meet all given conditions; none or 0 is no condition."""
    if category:
        df = df.filter(F.col("category") == category)
    if min_priority:
        df = df.filter(F.col("priority") >= min_priority)
    return df.filter(F.col("confidence_score") >= min_confidence) if min_confidence else df


def suggestions_by_category(df: DataFrame) -> DataFrame:
    """category, n, n_high (priority 4 and up), descriptions by falling priority."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), F.col("description").alias("d"))))
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("priority") >= 4).alias("n_high"), F.array_join(F.transform(ordered, lambda x: x["d"]), "|").alias("descriptions"))


def verify_metadata(expected: DataFrame, actual: DataFrame, params_tol: float = 0.05, size_tol: float = 0.1) -> DataFrame:
    """model, discrepancy: where parameters, size or latency leave the expected range."""
    both = expected.join(actual, "model", "left")
    off = lambda a, b, tol: F.try_divide(F.abs(F.col(a) - F.col(b)), F.col(b)) > tol
    found = F.array(F.when(F.col("actual_params").isNull(), "missing"), F.when(off("actual_params", "params", params_tol), "parameters"), F.when(off("actual_size_mb", "size_mb", size_tol), "size"), F.when(~F.col("actual_latency_ms").between(F.col("latency_min_ms"), F.col("latency_max_ms")), "latency"))
    return both.select("model", F.explode(F.array_compact(found)).alias("discrepancy"))
