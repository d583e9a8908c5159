"""Registered measurement, telemetry and registry queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.operators import measure, registry, telemetry
from fieldglass.plans.facts import derived, derived_sql
from fieldglass.plans.quality import read, rounded
from fieldglass.reftables import values_sql


def _events(spark, sf_dir):
    """Events as measurements: the size of an input is its user's number within a hundred, trials are event ids."""
    return read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id", "value", (F.pmod("user_id", F.lit(50)) + 1).alias("size"))


SIZED = "(SELECT event_id, ts, event_type, user_id, value, user_id % 50 + 1 AS size FROM events)"


def ms_stats(spark, sf_dir):
    return rounded(measure.stats(_events(spark, sf_dir), ["event_type"], "value"))


def ms_memory_stats(spark, sf_dir):
    return rounded(measure.stats(_events(spark, sf_dir), ["size"], "value", with_cv=False))


def ms_filtered_stats(spark, sf_dir):
    flagged = measure.outlier_flags(_events(spark, sf_dir), ["event_type"], "value")
    return rounded(measure.stats(flagged.filter("not is_outlier"), ["event_type"], "value"))


def ms_outlier_share(spark, sf_dir):
    return rounded(measure.outlier_share(measure.outlier_flags(_events(spark, sf_dir), ["size"], "value"), ["size"]))


def ms_zscore_flags(spark, sf_dir):
    return measure.outlier_flags(_events(spark, sf_dir), ["event_type"], "value", "zscore", 2.5).filter("is_outlier").select("event_id", "event_type")


def ms_percentiles(spark, sf_dir):
    return rounded(measure.percentiles(_events(spark, sf_dir), ["event_type"], "value"))


def ms_batch_stats(spark, sf_dir):
    return rounded(measure.batch_stats(_events(spark, sf_dir), "size", "value"))


def ms_early_stop(spark, sf_dir):
    kept = measure.early_stop(_events(spark, sf_dir), ["event_type"], "size", "event_id", "value", 400.0)
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_run"), F.max("size").alias("last_size"))


def ms_complexity_fit(spark, sf_dir):
    """Fits of total value per size, per event type."""
    totals = _events(spark, sf_dir).groupBy("event_type", "size").agg(F.sum("value").alias("total"))
    return rounded(measure.best_complexity(totals, ["event_type"], "size", "total"), 4)




def ms_complexity_vectors(spark, sf_dir):
    return rounded(measure.best_complexity(derived(spark, sf_dir, "vectors"), ["name"], "n", "y"))




def ms_highest_complexity(spark, sf_dir):
    return measure.highest_complexity(derived(spark, sf_dir, "mentions"), ["name"], "said")


def ms_robust_stats(spark, sf_dir):
    return rounded(measure.robust_stats(_events(spark, sf_dir), ["event_type"], "value"))


def ms_memory_scaling(spark, sf_dir):
    """Prices as memory that grows with the quantity, by discount and by supplier; suppliers hold few rows, discounts many."""
    li = read(spark, sf_dir, "lineitem")
    out = None
    for key in ("l_discount", "l_suppkey"):
        part = measure.memory_scaling(li.withColumn("k", F.col(key).cast("double")), ["k"], "l_quantity", "l_extendedprice", 100.0).withColumn("grouping", F.lit(key))
        out = part if out is None else out.unionByName(part)
    return rounded(out.filter("slope is not null"), 4)


def ms_deltas(spark, sf_dir):
    out = measure.deltas(_events(spark, sf_dir).withColumn("ts2", F.col("ts")), ["user_id"], "ts2").groupBy("user_id").agg(F.max("delta_s").alias("max_delta_s"), F.count("delta_s").alias("n"))
    return rounded(out)


def ms_weighted_efficiency(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return rounded(measure.weighted_efficiency(li, F.col("l_discount"), F.col("l_quantity"), F.col("l_returnflag") == "R"))


def ms_speedups(spark, sf_dir):
    per = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("seconds"))
    return rounded(measure.speedups(per, ["l_returnflag"], "seconds"))




def ms_scaling(spark, sf_dir):
    return rounded(measure.scaling_efficiency(derived(spark, sf_dir, "scaling"), "devices", "throughput"))


def ms_slow_functions(spark, sf_dir):
    """Series whose mean is above a limit, slowest first, five at most."""
    means = _events(spark, sf_dir).groupBy("user_id").agg(F.avg("value").alias("mean")).filter("mean > 50")
    return rounded(means.orderBy(F.desc("mean"), "user_id").limit(5))


def ms_monitor(spark, sf_dir):
    # a mean that lies midway between two roundings is moved off that point, so that the order of addition doesn't decide
    out = _events(spark, sf_dir).groupBy(F.date_trunc("day", "ts").alias("day")).agg((F.avg("value") + 1e-9).alias("avg_value"), F.max("value").alias("max_value"), F.countDistinct("user_id").alias("n_users"))
    return rounded(out)


def th_history(spark, sf_dir):
    return telemetry.trailing(read(spark, sf_dir, "events"), "ts", 7).select("event_id", "event_type")


def th_date_range(spark, sf_dir):
    return telemetry.date_range(read(spark, sf_dir, "events"), "ts", "2024-01-05", "2024-01-09", "event_type", ["view", "click"]).select("event_id", "event_type")


def th_series_stats(spark, sf_dir):
    value = F.when(F.pmod("event_id", F.lit(7)) != 0, F.col("value"))
    return rounded(telemetry.series_stats(read(spark, sf_dir, "events").withColumn("value", value), ["event_type"], "value"))


def th_latest_per_series(spark, sf_dir):
    return rounded(telemetry.latest(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", ["event_type", "value"]).select("user_id", "event_id", "event_type", "value"))


def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def _promotions(spark, sf_dir):
    """Events as promotions: users are models, odd values versions; views go to staging, purchases to production."""
    ev = read(spark, sf_dir, "events").filter("event_type in ('view', 'purchase')")
    return ev.select(F.col("user_id").alias("model"), F.concat(F.lit("v"), F.pmod("event_id", F.lit(5))).alias("version"), F.when(F.col("event_type") == "view", "staging").otherwise("production").alias("stage"), F.col("ts").alias("promoted_at"), F.col("event_id").alias("seq"))


PROMO = "(SELECT user_id AS model, 'v' || (event_id % 5) AS version, CASE event_type WHEN 'view' THEN 'staging' ELSE 'production' END AS stage, ts AS promoted_at, event_id AS seq FROM events WHERE event_type IN ('view', 'purchase'))"


def rg_latest_promotion(spark, sf_dir):
    return registry.pointers(_promotions(spark, sf_dir))


def rg_status(spark, sf_dir):
    return registry.status(_promotions(spark, sf_dir))


def rg_latest_version(spark, sf_dir):
    return registry.latest_version(_promotions(spark, sf_dir).select("model", "version", F.col("promoted_at").alias("created_at")))


def _metrics(spark, sf_dir, flag):
    li = read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag)
    return li.groupBy(F.concat(F.lit("supp_"), F.pmod("l_suppkey", F.lit(40))).alias("metric")).agg(F.round(F.avg("l_discount"), 6).alias("value"))


def rg_version_diff(spark, sf_dir):
    a = _metrics(spark, sf_dir, "A").filter("metric <> 'supp_3'").unionByName(spark.createDataFrame([("zero", 0.0)], "metric string, value double"))
    b = _metrics(spark, sf_dir, "R").filter("metric <> 'supp_5'").unionByName(spark.createDataFrame([("zero", 0.0)], "metric string, value double"))
    return rounded(registry.compare(a, b), 4)


def rg_feedback_latest(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(F.col("user_id").alias("suggestion_id"), F.col("event_type").alias("feedback"), F.col("ts").alias("at"), "event_id")
    return registry.current(ev, ["suggestion_id"], ["at", "event_id"]).select("suggestion_id", "feedback", "event_id")


def rg_upsert(spark, sf_dir):
    """Orders as model statistics: the last order of a customer replaces the ones before."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return rounded(registry.current(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice"))


def rg_flatten_metrics(spark, sf_dir):
    runs = read(spark, sf_dir, "nation").select("n_nationkey", F.create_map(F.lit("region"), F.col("n_regionkey").cast("double"), F.lit("key2"), (F.col("n_nationkey") * 2).cast("double")).alias("m"))
    return registry.flatten_metrics(runs, ["n_nationkey"], "m", "run")


def rg_merge_metadata(spark, sf_dir):
    m = lambda *kv: F.create_map(*[F.lit(x).cast("string") if isinstance(x, str) else x.cast("string") for x in kv])
    base = read(spark, sf_dir, "nation").select("n_nationkey", m("name", F.col("n_name"), "region", F.col("n_regionkey")).alias("meta"))
    new = read(spark, sf_dir, "nation").filter("n_regionkey = 1").select("n_nationkey", m("region", "one", "extra", F.col("n_nationkey")).alias("meta"))
    out = registry.merge_metadata(base, new, ["n_nationkey"], "meta")
    return out.select("n_nationkey", *[F.try_element_at("meta", F.lit(k)).alias(k) for k in ("name", "region", "extra")])




def rg_suggestion_filter(spark, sf_dir):
    return registry.suggestion_filter(derived(spark, sf_dir, "suggestions"), None, 3, 0.8)


def rg_suggestions_by_category(spark, sf_dir):
    return registry.suggestions_by_category(derived(spark, sf_dir, "suggestions"))




def rg_verify_metadata(spark, sf_dir):
    return registry.verify_metadata(derived(spark, sf_dir, "expected"), derived(spark, sf_dir, "actual"))


NAMES = [n for n in dir() if n.startswith(("ms_", "th_", "rg_", "json_"))]
QUERIES = {n: globals()[n] for n in NAMES}

_GROWTH = "[(0, 'O(1)', 1.0), (1, 'O(log n)', ln(n)), (2, 'O(n)', n), (3, 'O(n log n)', n * ln(n)), (4, 'O(n^2)', n * n), (5, 'O(n^3)', n * n * n), (6, 'O(2^n)', pow(2.0, n))]"


def _fit(source: str, key: str, places: int) -> str:
    return f"""WITH p AS ({source}), g AS (SELECT k, y, u[1] AS pos, u[2] AS complexity, CAST(u[3] AS DOUBLE) AS x FROM (SELECT k, y, unnest({_GROWTH}) AS u FROM p WHERE n > 0)),
  f AS (SELECT k, pos, complexity, CASE WHEN var_pop(y) = 0 THEN 0 WHEN var_pop(x) = 0 THEN 0 ELSE regr_r2(y, x) END AS r2 FROM g GROUP BY ALL HAVING count(*) >= 3 AND max(x) < CAST('inf' AS DOUBLE)),
  b AS (SELECT k, complexity, r2 FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(r2, 12) DESC, pos) = 1)
SELECT k AS {key}, coalesce(complexity, 'Unknown') AS complexity, round(coalesce(r2, 0), {places}) AS quality FROM (SELECT DISTINCT k FROM p) LEFT JOIN b USING (k)"""


def _stats(source: str, key: str, cv: bool = True) -> str:
    more = ", round(coalesce(CASE WHEN count(value) > 1 THEN stddev_samp(value) ELSE 0 END / nullif(avg(value), 0), 0), 6) AS cv" if cv else ""
    return f"SELECT {key}, count(value) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(CASE WHEN count(value) > 1 THEN stddev_samp(value) ELSE 0 END, 6) AS stdev, round(CASE WHEN count(value) > 1 THEN var_samp(value) ELSE 0 END, 6) AS variance{more} FROM {source} GROUP BY {key}"


def _flags(key: str) -> str:
    return f"(SELECT e.*, n >= 4 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS is_outlier FROM {SIZED} e JOIN (SELECT {key}, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {SIZED} GROUP BY {key}) USING ({key}))"


ORACLES = {
    "ms_stats": _stats("events", "event_type"),
    "ms_memory_stats": _stats(SIZED, "size", False),
    "ms_filtered_stats": _stats(f"(SELECT * FROM {_flags('event_type')} WHERE NOT is_outlier)", "event_type"),
    "ms_outlier_share": f"SELECT size, count(*) AS n, count(*) FILTER (is_outlier) AS n_outliers, round(100.0 * count(*) FILTER (is_outlier) / count(*), 6) AS outlier_percent FROM {_flags('size')} GROUP BY size",
    "ms_zscore_flags": "SELECT event_id, event_type FROM events JOIN (SELECT event_type, count(value) AS n, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) USING (event_type) WHERE n >= 4 AND s > 0 AND abs(value - m) > 2.5 * s",
    "ms_percentiles": "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "ms_batch_stats": f"SELECT size, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(size / nullif(avg(value), 0), 6) AS throughput FROM {SIZED} GROUP BY size",
    "ms_early_stop": f"SELECT event_type, count(*) AS n_run, max(size) AS last_size FROM (SELECT *, coalesce(max(CASE WHEN value > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY size, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM {SIZED}) WHERE s = 0 GROUP BY 1",
    "ms_complexity_fit": _fit(f"SELECT event_type AS k, CAST(size AS DOUBLE) AS n, sum(value) AS y FROM {SIZED} GROUP BY 1, 2", "event_type", 4),
    "ms_complexity_vectors": _fit(f"WITH {derived_sql("vectors", "v")} SELECT name AS k, n, y FROM v", "name", 6),
    "ms_highest_complexity": f"WITH {derived_sql('mentions', 'm')} SELECT name, coalesce((['" + "', '".join(n for n, _ in measure.CLASSES) + "'])[max(" + "greatest(" + ", ".join(f"CASE WHEN contains(said, '{n}') THEN {i} ELSE 0 END" for i, (n, _) in enumerate(measure.CLASSES, 1)) + "))], 'Unknown') AS complexity FROM m GROUP BY name",
    "ms_robust_stats": "WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS med FROM events GROUP BY 1) SELECT event_type, round(max(med), 6) AS median, round(quantile_cont(abs(value - med), 0.5), 6) AS mad, round(quantile_cont(abs(value - med), 0.5) * 1.4826 / nullif(max(med), 0), 6) AS robust_cv FROM events JOIN m USING (event_type) GROUP BY 1",
    "ms_memory_scaling": "\nUNION ALL ".join(f"""SELECT k, '{key}' AS grouping, round(med, 4) AS per_sample, round(mad * 1.4826 / (med + 1e-6), 4) AS spread, round(slope, 4) AS slope, round(r2, 4) AS r2,
      round(0.4 * greatest(r2, 0) + 0.3 / (1 + mad * 1.4826 / (med + 1e-6)) + 0.3 * (1 - least(abs(slope - med) / (med + 1e-10), 1)), 4) AS quality FROM (
      SELECT k, any_value(med) AS med, quantile_cont(abs(y / x - med), 0.5) AS mad, regr_slope(y, x) AS slope, 1 - (regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (regr_syy(y, x) + 1e-10) AS r2 FROM (
      SELECT CAST({key} AS DOUBLE) AS k, l_quantity AS x, greatest(l_extendedprice - 100, 1e-6) AS y, quantile_cont(greatest(l_extendedprice - 100, 1e-6) / l_quantity, 0.5) OVER (PARTITION BY {key}) AS med FROM lineitem WHERE l_quantity > 0) GROUP BY k) WHERE slope IS NOT NULL AND NOT isnan(slope)""" for key in ("l_discount", "l_suppkey")),
    "ms_deltas": "SELECT user_id, round(max(d), 6) AS max_delta_s, count(d) AS n FROM (SELECT user_id, epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS d FROM events) GROUP BY 1",
    "ms_weighted_efficiency": "SELECT round(coalesce(sum(l_discount * l_quantity) FILTER (l_returnflag = 'R') / nullif(sum(l_quantity) FILTER (l_returnflag = 'R'), 0), 0), 6) AS efficiency FROM lineitem",
    "ms_speedups": "SELECT l_returnflag, l_linestatus, round(s, 6) AS seconds, round(min(s) OVER (PARTITION BY l_returnflag) / nullif(s, 0), 6) AS relative_speed FROM (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS s FROM lineitem GROUP BY ALL)",
    "ms_scaling": f"WITH {derived_sql("scaling", "v")} SELECT strategy, devices, throughput, round(throughput / ((SELECT max(throughput) FROM v WHERE devices = 1) * devices), 6) AS efficiency FROM v",
    "ms_slow_functions": "SELECT user_id, round(avg(value), 6) AS mean FROM events GROUP BY 1 HAVING avg(value) > 50 ORDER BY avg(value) DESC, user_id LIMIT 5",
    "ms_monitor": "SELECT date_trunc('day', ts) AS day, round(avg(value) + 1e-9, 6) AS avg_value, round(max(value), 6) AS max_value, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
    "th_history": "SELECT event_id, event_type FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
    "th_date_range": "SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09' AND event_type IN ('view', 'click')",
    "th_series_stats": "SELECT event_type, count(*) AS n, round(avg(v), 6) AS avg, round(max(v), 6) AS max, round(min(v), 6) AS min FROM (SELECT event_type, CASE WHEN event_id % 7 <> 0 THEN value ELSE 0 END AS v FROM events) GROUP BY 1",
    "th_latest_per_series": "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "json_props": "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
    "rg_latest_promotion": f"SELECT model, stage, version FROM {PROMO} QUALIFY row_number() OVER (PARTITION BY model, stage ORDER BY promoted_at DESC, seq DESC) = 1",
    "rg_status": f"SELECT model, version, stage AS status FROM {PROMO} QUALIFY row_number() OVER (PARTITION BY model, version ORDER BY promoted_at DESC, seq DESC) = 1",
    "rg_latest_version": f"SELECT model, version FROM {PROMO} QUALIFY row_number() OVER (PARTITION BY model ORDER BY promoted_at DESC, version DESC) = 1",
    "rg_version_diff": "WITH m AS (SELECT l_returnflag AS f, 'supp_' || (l_suppkey % 40) AS metric, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY ALL), a AS (SELECT metric, value FROM m WHERE f = 'A' AND metric <> 'supp_3' UNION ALL VALUES ('zero', 0.0)), b AS (SELECT metric, value FROM m WHERE f = 'R' AND metric <> 'supp_5' UNION ALL VALUES ('zero', 0.0)) SELECT metric, round(CAST(a.value AS DOUBLE), 4) AS v1, round(CAST(b.value AS DOUBLE), 4) AS v2, round(CAST(b.value - a.value AS DOUBLE), 4) + 0.0 AS diff, CASE WHEN b.value - a.value IS NOT NULL THEN CASE WHEN a.value = 0 THEN CAST('inf' AS DOUBLE) ELSE round(CAST((b.value - a.value) / a.value * 100 AS DOUBLE), 4) + 0.0 END END AS pct_change FROM a FULL JOIN b USING (metric)",
    "rg_feedback_latest": "SELECT user_id AS suggestion_id, event_type AS feedback, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "rg_upsert": "SELECT o_custkey, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "rg_flatten_metrics": "SELECT n_nationkey, 'run.region' AS metric, CAST(n_regionkey AS DOUBLE) AS value FROM nation UNION ALL SELECT n_nationkey, 'run.key2', CAST(n_nationkey * 2 AS DOUBLE) FROM nation",
    "rg_merge_metadata": "SELECT n_nationkey, n_name AS name, CASE WHEN n_regionkey = 1 THEN 'one' ELSE CAST(n_regionkey AS VARCHAR) END AS region, CASE WHEN n_regionkey = 1 THEN CAST(n_nationkey AS VARCHAR) END AS extra FROM nation",
    "rg_suggestion_filter": f"WITH {derived_sql("suggestions", "v")} SELECT * FROM v WHERE priority >= 3 AND confidence_score >= 0.8",
    "rg_suggestions_by_category": f"WITH {derived_sql("suggestions", "v")} SELECT category, count(*) AS n, count(*) FILTER (priority >= 4) AS n_high, string_agg(description, '|' ORDER BY priority DESC, description) AS descriptions FROM v GROUP BY 1",
    "rg_verify_metadata": f"WITH {derived_sql("expected", "e")}, {derived_sql("actual", "a")}, j AS (SELECT * FROM e LEFT JOIN a USING (model)) SELECT model, 'missing' AS discrepancy FROM j WHERE actual_params IS NULL UNION ALL SELECT model, 'parameters' FROM j WHERE abs(actual_params - params) / params > 0.05 UNION ALL SELECT model, 'size' FROM j WHERE abs(actual_size_mb - size_mb) / size_mb > 0.1 UNION ALL SELECT model, 'latency' FROM j WHERE NOT (actual_latency_ms BETWEEN latency_min_ms AND latency_max_ms)",
}
