"""Registered data-quality queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions.guards import one_row_to_long, string_columns
from fieldglass.operators import bias, drift, privacy, profile, schema

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_ALL = [*LINEITEM, "l_returnflag", "l_linestatus", "l_shipdate"]
SPLIT = "2024-01-16"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels where there are any: a table with missing values."""
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left")


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = read(spark, sf_dir, "events")
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    return events.filter(F.col("ts") < cut), events.filter(F.col("ts") >= cut)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places`` decimals, so that engines that add in another order agree."""
    return df.select(*[(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def dq_profile(spark, sf_dir):
    return rounded(profile.profile(read(spark, sf_dir, "lineitem")))


def dq_basic_profile(spark, sf_dir):
    return profile.basic_profile(read(spark, sf_dir, "lineitem"))


def dq_completeness(spark, sf_dir):
    return rounded(profile.completeness(labelled(spark, sf_dir)))


def dq_low_completeness(spark, sf_dir):
    return rounded(profile.completeness(labelled(spark, sf_dir))).filter("completeness < 90").select("column_name", "completeness")


def dq_uniqueness(spark, sf_dir):
    return rounded(profile.uniqueness(read(spark, sf_dir, "lineitem")))


def dq_missing(spark, sf_dir):
    return profile.missing(labelled(spark, sf_dir))


def dq_value_distribution(spark, sf_dir):
    return rounded(profile.value_distribution(read(spark, sf_dir, "customer"), "c_mktsegment"))


def dq_duplicates(spark, sf_dir):
    return profile.duplicates(read(spark, sf_dir, "documents"), ["text"])


def dq_duplicate_rows(spark, sf_dir):
    return profile.duplicates(read(spark, sf_dir, "documents").select("lang", "source", "text"))


def dq_quartiles(spark, sf_dir):
    return rounded(profile.outlier_bounds(read(spark, sf_dir, "lineitem"), LINEITEM))


def dq_outlier_rows(spark, sf_dir):
    return rounded(profile.outlier_rows(read(spark, sf_dir, "events"), ["event_id"], ["value"]))


def dq_outlier_counts(spark, sf_dir):
    return profile.outlier_counts(read(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


def dq_correlation(spark, sf_dir):
    return rounded(profile.correlation(read(spark, sf_dir, "lineitem"), LINEITEM))


def dq_strong_correlation(spark, sf_dir):
    """Over orders as a whole, whose lines, quantities and values grow together."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.sum(F.floor("l_extendedprice")).alias("worth"))
    return rounded(profile.strong_correlation(profile.correlation(lines)))


def dq_feature_types(spark, sf_dir):
    out = None
    for table in ("orders", "events", "labels", "region"):
        part = profile.feature_types(read(spark, sf_dir, table)).withColumn("table_name", F.lit(table))
        out = part if out is None else out.unionByName(part)
    return out


RULES = [("o_totalprice", "numeric", 1000.0, 400000.0, None), ("o_orderstatus", "categorical", None, None, ["F", "O"]), ("o_orderkey", "categorical", None, None, ["x"]), ("o_missing", "numeric", 0.0, 1.0, None)]


def dq_schema_validation(spark, sf_dir):
    return schema.validate(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey"), RULES)


def dq_schema_drift(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    changed = orders.drop("o_orderpriority").withColumn("new_column", F.lit(1)).withColumn("o_custkey", F.col("o_custkey").cast("string"))
    return schema.schema_drift(changed, orders)


def dq_invalid_categories(spark, sf_dir):
    return schema.invalid_categories(read(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


def dq_pii_scan(spark, sf_dir):
    return privacy.pii_scan(read(spark, sf_dir, "documents"), ["text"]).unionByName(privacy.pii_scan(read(spark, sf_dir, "conversations"), ["text"]).withColumn("column_name", F.lit("turn_text")))


def dq_quasi_identifiers(spark, sf_dir):
    return rounded(privacy.quasi_identifiers(read(spark, sf_dir, "orders")))


def dq_risk_level(spark, sf_dir):
    out = None
    for table in ("orders", "region"):
        part = privacy.risk_level(read(spark, sf_dir, table)).withColumn("table_name", F.lit(table))
        out = part if out is None else out.unionByName(part)
    return out


def dq_bias_distribution(spark, sf_dir):
    return rounded(bias.distribution(labelled(spark, sf_dir), "lang"))


def dq_bias_target_by_group(spark, sf_dir):
    return rounded(bias.target_by_group(labelled(spark, sf_dir), "lang", "quality"))


def dq_bias_mean_by_group(spark, sf_dir):
    return rounded(bias.target_by_group(read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"))


def dq_demographic_parity(spark, sf_dir):
    return rounded(bias.parity_gap(labelled(spark, sf_dir), "lang", "toxic"))


def drift_ks(spark, sf_dir):
    return rounded(drift.ks(*halves(spark, sf_dir), "value"))


def drift_chi_square(spark, sf_dir):
    return rounded(drift.chi_square(*halves(spark, sf_dir), "event_type"))


def drift_chi_square_p(spark, sf_dir):
    return rounded(drift.chi_square_test(*halves(spark, sf_dir), "event_type"))


def drift_category_alignment(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    return drift.category_counts(a, b.filter("event_type <> 'view'"), "event_type")


def drift_category_shift(spark, sf_dir):
    return rounded(drift.category_shift(*halves(spark, sf_dir), "event_type"))


def drift_summary(spark, sf_dir):
    return rounded(drift.summary(*halves(spark, sf_dir), ["value", "user_id"], ["event_type"]))


def dq_anonymize(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.col("c_name"), 256).alias("name_hash"))


def dq_impute_and_clip(spark, sf_dir):
    """Mean imputation of missing labels and clipping of values to three standard deviations."""
    rows = labelled(spark, sf_dir).select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("n_chars").cast("double").alias("n_chars"))
    stats = rows.agg(F.avg("quality").alias("m"), F.avg("n_chars").alias("a"), F.stddev_pop("n_chars").alias("s"))
    return rounded(rows.crossJoin(stats).select("doc_id", F.coalesce("quality", "m").alias("quality"), F.least(F.greatest("n_chars", F.col("a") - 3 * F.col("s")), F.col("a") + 3 * F.col("s")).alias("n_chars")))


def opt_dedupe(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def opt_fill_missing(spark, sf_dir):
    """How many cells filling would fix and how many rows dropping would lose, per column."""
    df = labelled(spark, sf_dir)
    return profile.completeness(df).filter("n_missing > 0").select("column_name", F.col("n_missing").alias("n_filled"), (F.col("n_rows") - F.col("n_missing")).alias("n_rows_left"))


def opt_dtype_advice(spark, sf_dir):
    """The narrowest integer type for each whole-number column, and dictionary coding for columns of few values."""
    df = read(spark, sf_dir, "lineitem")
    ints = [c for c, t in df.dtypes if t in ("int", "bigint")]
    one = df.agg(*[x for i, c in enumerate(ints) for x in (F.min(c).cast("long").alias(f"lo__{i}"), F.max(c).cast("long").alias(f"hi__{i}"))])
    ranges = one_row_to_long(one, ints, ["lo", "hi"])
    advice = F.when(F.col("lo").between(-128, 127) & F.col("hi").between(-128, 127), "tinyint").when((F.col("lo") >= -32768) & (F.col("hi") <= 32767), "smallint").when((F.col("lo") >= -2147483648) & (F.col("hi") <= 2147483647), "int").otherwise("bigint")
    numbers = ranges.select("column_name", advice.alias("advice"))
    texts = profile.uniqueness(df.select(*string_columns(df))).select("column_name", F.when(F.col("uniqueness") < 50, "dictionary").otherwise("string").alias("advice"))
    return numbers.unionByName(texts)


NAMES = "dq_profile dq_basic_profile dq_completeness dq_low_completeness dq_uniqueness dq_missing dq_value_distribution dq_duplicates dq_duplicate_rows dq_quartiles dq_outlier_rows dq_outlier_counts dq_correlation dq_strong_correlation dq_feature_types dq_schema_validation dq_schema_drift dq_invalid_categories dq_pii_scan dq_quasi_identifiers dq_risk_level dq_bias_distribution dq_bias_target_by_group dq_bias_mean_by_group dq_demographic_parity drift_ks drift_chi_square drift_chi_square_p drift_category_alignment drift_category_shift drift_summary dq_anonymize dq_impute_and_clip opt_dedupe opt_fill_missing opt_dtype_advice".split()
QUERIES = {n: globals()[n] for n in NAMES}

LABELLED = "(SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
LAB_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
HALVES = f"old AS (SELECT * FROM events WHERE ts < TIMESTAMP '{SPLIT}'), new AS (SELECT * FROM events WHERE ts >= TIMESTAMP '{SPLIT}')"


def _union(parts) -> str:
    return "\nUNION ALL ".join(parts)


def _bounds(table: str, cols: list[str]) -> str:
    one = lambda c: f"SELECT '{c}' AS column_name, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table}"
    return f"SELECT column_name, q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM ({_union(one(c) for c in cols)})"


def _outliers(table: str, cols: list[str]) -> str:
    one = lambda c: f"SELECT '{c}' AS column_name, (SELECT count(*) FROM {table}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table}) b WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers"
    return _union(one(c) for c in cols)


def _uniqueness(table: str, cols: list[str]) -> str:
    return _union(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, round(100.0 * count(DISTINCT {c}) / nullif(count(*), 0), 6) AS uniqueness FROM {table}" for c in cols)


def _completeness(table: str, cols: list[str]) -> str:
    return _union(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_missing, round(100.0 * count({c}) / nullif(count(*), 0), 6) AS completeness FROM {table}" for c in cols)


def _corr(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


_KS = f"""WITH {HALVES}, cell AS (SELECT value AS x, 1 AS r, 0 AS c FROM old UNION ALL SELECT value, 0, 1 FROM new),
  step AS (SELECT x, sum(sum(r)) OVER (ORDER BY x) AS r, sum(sum(c)) OVER (ORDER BY x) AS c FROM cell WHERE x IS NOT NULL GROUP BY x),
  size AS (SELECT sum(r) AS nr, sum(c) AS nc FROM cell WHERE x IS NOT NULL),
  stat AS (SELECT max(CAST(nr AS BIGINT)) AS n_reference, max(CAST(nc AS BIGINT)) AS n_current, max(abs(CAST(r AS DOUBLE) / nr - CAST(c AS DOUBLE) / nc)) AS d FROM step, size),
  tail AS (SELECT *, CASE WHEN d <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0 * list_sum([(CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * d * d * (CAST(n_reference AS DOUBLE) * n_current / (n_reference + n_current))) FOR k IN range(1, 101)]))) END AS p FROM stat)
SELECT n_reference, n_current, round(d, 6) AS d, round(p, 6) AS p_value, p < 0.05 AS drifted FROM tail"""



def _ks(column: str) -> str:
    return _KS.replace("SELECT value AS x", f"SELECT {column} AS x").replace("UNION ALL SELECT value, 0, 1", f"UNION ALL SELECT {column}, 0, 1")


_SHARES = f"""WITH {HALVES}, r AS (SELECT event_type AS value, count(*) AS n FROM old WHERE event_type IS NOT NULL GROUP BY 1), c AS (SELECT event_type AS value, count(*) AS n FROM new WHERE event_type IS NOT NULL GROUP BY 1),
  cell AS (SELECT value, coalesce(r.n, 0) AS n_reference, coalesce(c.n, 0) AS n_current FROM r FULL JOIN c USING (value)),
  tot AS (SELECT sum(n_reference) AS tr, sum(n_current) AS tc FROM cell)"""

_LINES = ("l_orderkey", "n_lines", "quantity", "worth")
_CHI = f"{_SHARES} SELECT sum(CASE WHEN n_reference = 0 THEN CASE WHEN n_current > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END ELSE pow(n_current - n_reference / tr * tc, 2) / (n_reference / tr * tc) END) AS statistic, count(*) - 1 AS dof, CASE WHEN count(*) FILTER (n_reference = 0 AND n_current > 0) > 0 THEN 'new category' END AS reason FROM cell, tot"
#: The tail is a finite sum for even degrees of freedom, which the five event types give.
_CHI_P = f"SELECT *, CASE WHEN dof % 2 = 0 THEN exp(-statistic / 2) * list_sum([pow(statistic / 2, i) / factorial(CAST(i AS INTEGER)) FOR i IN range(dof // 2)]) END AS p FROM ({_CHI})"

ORACLES = {
    "drift_chi_square_p": f"SELECT round(statistic, 6) AS statistic, dof, reason, round(p, 6) AS p_value, p < 0.05 AS drifted FROM ({_CHI_P})",
    "drift_summary": f"WITH t AS (SELECT 'value' AS column_name, 'ks' AS test, d AS statistic, p_value, drifted FROM ({_ks('value')}) UNION ALL SELECT 'user_id', 'ks', d, p_value, drifted FROM ({_ks('user_id')}) UNION ALL SELECT 'event_type', 'chi_square', round(statistic, 6), round(p, 6), p < 0.05 FROM ({_CHI_P})) SELECT *, round((SELECT count(*) FROM t WHERE drifted) / 6, 6) AS drift_score FROM t",
    "dq_profile": "SELECT c.column_name, c.completeness, u.uniqueness, CAST(o.n_outliers AS DOUBLE) AS n_outliers FROM (" + _completeness("lineitem", LINEITEM_ALL) + ") c JOIN (" + _uniqueness("lineitem", LINEITEM_ALL) + ") u USING (column_name) LEFT JOIN (" + _outliers("lineitem", LINEITEM) + ") o USING (column_name)",
    "dq_basic_profile": "SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count FROM lineitem",
    "dq_completeness": _completeness(LABELLED, LAB_COLS),
    "dq_low_completeness": f"SELECT column_name, completeness FROM ({_completeness(LABELLED, LAB_COLS)}) WHERE completeness < 90",
    "dq_uniqueness": _uniqueness("lineitem", LINEITEM_ALL),
    "dq_missing": f"WITH m AS ({_completeness(LABELLED, LAB_COLS)}) SELECT column_name, n_missing FROM m UNION ALL SELECT '*', CAST(sum(n_missing) AS BIGINT) FROM m",
    "dq_value_distribution": "SELECT c_mktsegment AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1",
    "dq_duplicates": "SELECT count(*) AS n_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_surplus FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)",
    "dq_duplicate_rows": "SELECT count(*) AS n_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_surplus FROM (SELECT count(*) AS n FROM documents GROUP BY lang, source, text HAVING count(*) > 1)",
    "dq_quartiles": "SELECT column_name, round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower, 6) AS lower, round(upper, 6) AS upper FROM (" + _bounds("lineitem", LINEITEM) + ")",
    "dq_outlier_rows": "SELECT 'value' AS column_name, event_id, round(value, 6) AS value FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)",
    "dq_outlier_counts": _outliers("orders", ["o_orderkey", "o_custkey", "o_totalprice"]),
    "dq_correlation": _union(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round({_corr(a, b)}, 6) AS r FROM lineitem" for a in LINEITEM for b in LINEITEM),
    "dq_strong_correlation": "WITH lines AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS quantity, sum(floor(l_extendedprice)) AS worth FROM lineitem GROUP BY 1) SELECT column_a, column_b, round(r, 6) AS r FROM (" + _union(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {_corr(a, b)} AS r FROM lines" for a in _LINES for b in _LINES if a != b) + ") WHERE abs(r) > 0.7 ORDER BY abs(r) DESC, column_a, column_b LIMIT 10",
    "dq_feature_types": _union(
        f"SELECT '{c}' AS column_name, CASE WHEN {num} THEN CASE WHEN count(DISTINCT {c}) <= 2 THEN 'binary' ELSE 'numeric' END WHEN {date} THEN 'datetime' WHEN avg(CASE WHEN regexp_matches(CAST({c} AS VARCHAR), '^\\d{{2,4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}') THEN 1.0 ELSE 0.0 END) FILTER ({c} IS NOT NULL) > 0.7 THEN 'datetime' WHEN count(DISTINCT {c}) <= 10 OR (count(DISTINCT {c}) / count(*) < 0.05 AND count(DISTINCT {c}) <= 100) THEN 'categorical' ELSE 'text' END AS feature_type, '{t}' AS table_name FROM {t}"
        for t, c, num, date in [("orders", "o_orderkey", "true", "false"), ("orders", "o_custkey", "true", "false"), ("orders", "o_orderstatus", "false", "false"), ("orders", "o_totalprice", "true", "false"), ("orders", "o_orderdate", "false", "true"), ("orders", "o_orderpriority", "false", "false"), ("events", "event_id", "true", "false"), ("events", "ts", "false", "true"), ("events", "user_id", "true", "false"), ("events", "event_type", "false", "false"), ("events", "value", "true", "false"), ("events", "props", "false", "false"), ("labels", "doc_id", "true", "false"), ("labels", "quality", "true", "false"), ("labels", "toxic", "true", "false"), ("region", "r_regionkey", "true", "false"), ("region", "r_name", "false", "false")]
    ),
    "dq_schema_validation": "SELECT 'o_totalprice' AS column_name, 'below_min' AS issue, CAST(min(o_totalprice) AS VARCHAR) AS detail FROM orders HAVING min(o_totalprice) < 1000 UNION ALL SELECT 'o_totalprice', 'above_max', CAST(max(o_totalprice) AS VARCHAR) FROM orders HAVING max(o_totalprice) > 400000 UNION ALL SELECT DISTINCT 'o_orderstatus', 'invalid_category', o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL VALUES ('o_orderkey', 'wrong_type', 'bigint'), ('o_missing', 'missing', NULL), ('o_custkey', 'unexpected', NULL)",
    "dq_schema_drift": """WITH r AS (SELECT column_name, lower(column_type) AS t FROM (DESCRIBE SELECT * FROM orders)), c AS (SELECT column_name, lower(column_type) AS t FROM (DESCRIBE SELECT * EXCLUDE (o_orderpriority) REPLACE (CAST(o_custkey AS VARCHAR) AS o_custkey), CAST(1 AS INTEGER) AS new_column FROM orders)),
      named AS (SELECT column_name, CASE r.t WHEN 'varchar' THEN 'string' WHEN 'integer' THEN 'int' ELSE r.t END AS reference_type, CASE c.t WHEN 'varchar' THEN 'string' WHEN 'integer' THEN 'int' ELSE c.t END AS current_type FROM r FULL JOIN c USING (column_name))
      SELECT CASE WHEN reference_type IS NULL THEN 'added' WHEN current_type IS NULL THEN 'removed' ELSE 'type_changed' END AS change, column_name, reference_type, current_type FROM named WHERE reference_type IS DISTINCT FROM current_type""",
    "dq_invalid_categories": "SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1",
    "dq_pii_scan": _union(f"SELECT '{n}' AS column_name, '{k}' AS kind, count(*) FILTER (regexp_matches(text, '{p}')) AS n_rows FROM {t}" for t, n in (("documents", "text"), ("conversations", "turn_text")) for k, p in privacy.PII.items()),
    "dq_quasi_identifiers": f"SELECT column_name, uniqueness FROM ({_uniqueness('orders', ORDER_COLS)}) WHERE uniqueness > 80 AND uniqueness < 100",
    "dq_risk_level": _union(
        f"SELECT n_pii, n_quasi, CASE WHEN n_pii > 0 THEN 'high' WHEN n_quasi > 0 THEN 'medium' ELSE 'low' END AS risk, '{t}' AS table_name FROM (SELECT count(*) FILTER (n > 0) AS n_pii FROM ("
        + _union(f"SELECT count(*) FILTER (regexp_matches({c}, '{p}')) AS n FROM {t}" for c in texts for p in privacy.PII.values())
        + f")), (SELECT count(*) AS n_quasi FROM ({_uniqueness(t, cols)}) WHERE uniqueness > 80 AND uniqueness < 100)"
        for t, texts, cols in (("orders", ["o_orderstatus", "o_orderpriority"], ORDER_COLS), ("region", ["r_name"], ["r_regionkey", "r_name"]))
    ),
    "dq_bias_distribution": f"SELECT lang AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM {LABELLED} WHERE lang IS NOT NULL GROUP BY 1",
    "dq_bias_target_by_group": f"SELECT lang AS attribute, CAST(quality AS VARCHAR) AS target_value, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS value FROM {LABELLED} WHERE lang IS NOT NULL AND quality IS NOT NULL GROUP BY lang, quality",
    "dq_bias_mean_by_group": "SELECT o_orderpriority AS attribute, CAST(NULL AS VARCHAR) AS target_value, round(avg(o_totalprice), 6) AS value FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1",
    "dq_demographic_parity": f"SELECT round(min(r), 6) AS min_rate, round(max(r), 6) AS max_rate, round(max(r) - min(r), 6) AS parity_gap FROM (SELECT avg(toxic) AS r FROM {LABELLED} WHERE lang IS NOT NULL GROUP BY lang HAVING avg(toxic) IS NOT NULL)",
    "drift_ks": _KS,
    "drift_chi_square": f"{_SHARES} SELECT round(sum(CASE WHEN n_reference = 0 THEN CASE WHEN n_current > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END ELSE pow(n_current - n_reference / tr * tc, 2) / (n_reference / tr * tc) END), 6) AS statistic, count(*) - 1 AS dof, CASE WHEN count(*) FILTER (n_reference = 0 AND n_current > 0) > 0 THEN 'new category' END AS reason FROM cell, tot",
    "drift_category_alignment": f"WITH {HALVES}, r AS (SELECT event_type AS value, count(*) AS n FROM old GROUP BY 1), c AS (SELECT event_type AS value, count(*) AS n FROM new WHERE event_type <> 'view' GROUP BY 1) SELECT value, coalesce(r.n, 0) AS n_reference, coalesce(c.n, 0) AS n_current FROM r FULL JOIN c USING (value)",
    "drift_category_shift": f"{_SHARES}, s AS (SELECT value, n_current / tc - n_reference / tr AS shift FROM cell, tot) SELECT value, round(shift, 6) AS shift, (SELECT round(sum(abs(shift)) / 2, 6) FROM s) AS total_variation FROM s ORDER BY abs(shift) DESC, value LIMIT 3",
    "dq_anonymize": "SELECT c_custkey, sha256(c_name) AS name_hash FROM customer",
    "dq_impute_and_clip": f"WITH t AS {LABELLED}, s AS (SELECT avg(quality) AS m, avg(n_chars) AS a, stddev_pop(n_chars) AS s FROM t) SELECT doc_id, round(coalesce(CAST(quality AS DOUBLE), m), 6) AS quality, round(least(greatest(CAST(n_chars AS DOUBLE), a - 3 * s), a + 3 * s), 6) AS n_chars FROM t, s",
    "opt_dedupe": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "opt_fill_missing": f"SELECT column_name, n_missing AS n_filled, n_rows - n_missing AS n_rows_left FROM ({_completeness(LABELLED, LAB_COLS)}) WHERE n_missing > 0",
    "opt_dtype_advice": _union([*(f"SELECT '{c}' AS column_name, CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS advice FROM lineitem" for c in LINEITEM[:4]), *(f"SELECT '{c}', CASE WHEN 100.0 * count(DISTINCT {c}) / count(*) < 50 THEN 'dictionary' ELSE 'string' END FROM lineitem" for c in ("l_returnflag", "l_linestatus"))]),
}
