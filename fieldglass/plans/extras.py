"""Registered queries for sources, streams and the generic relational operations that come with Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldglass.functions.stages import shared_dir
from fieldglass.operators import profile
from fieldglass.plans.quality import _completeness, read, rounded
from fieldglass.sources import arrays, io
from fieldglass.streaming import monitor


def src_file_kinds(spark, sf_dir):
    """Files by ending and rows by content."""
    by_name = io.file_kinds(read(spark, sf_dir, "documents")).select("kind")
    return io.rows_by_kind(spark, f"{sf_dir}/documents.parquet").join(by_name, "kind").select("kind", "n_rows")


def src_int_keyed(spark, sf_dir):
    """A mapping from 40 batch sizes to numbers, as it is exported, back as rows; the numbers are means of order lines."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("size")).agg(F.max("l_extendedprice").alias("mean"), F.count(F.lit(1)).alias("n")).filter("size <= 40")
    exported = {r["size"]: {"mean": r["mean"]} | ({"throughput": float(r["n"])} if r["size"] % 2 else {}) for r in lines.collect()}  # at most 40 rows
    return io.int_keyed_to_rows(spark, exported, "batch_size")


def _scratch(spark, label):
    return f"{shared_dir(spark)}/fieldglass/{label}-{uuid.uuid4().hex}"


def src_array_files(spark, sf_dir):
    """Vectors written as array files and read back by ranges of rows."""
    vectors, path = read(spark, sf_dir, "embeddings").filter("vec_id is not null and embedding is not null"), _scratch(spark, "arrays")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    arrays.register(spark)
    vectors.select(F.col("vec_id").cast("double").alias("id"), *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(width)]).write.format("arrays").mode("append").option("path", path).save()
    back = spark.read.format("arrays").option("path", path).load()
    total = sum((F.col(f"c{i}") for i in range(1, width + 1)), F.lit(0.0))
    return rounded(back.select(F.col("c0").cast("long").alias("vec_id"), F.col("c1").alias("first"), F.col(f"c{width}").alias("last"), total.alias("total")), 4)


def src_validation_set(spark, sf_dir):
    """A validation set as CSV: features and, in the last column, the target."""
    path = _scratch(spark, "validation") + ".csv"
    read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", F.col("l_returnflag").alias("target")).write.option("header", True).csv(path)
    df, target = io.read_validation(spark, path)
    return rounded(df.groupBy(F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.max("l_discount").alias("most")))


def src_json_results(spark, sf_dir):
    """A profile written as JSON lines and read back."""
    path = _scratch(spark, "results")
    io.write_json(rounded(profile.completeness(read(spark, sf_dir, "orders"))), path)
    return spark.read.schema("column_name string, n_rows long, n_missing long, completeness double").json(path)


def src_registry_document(spark, sf_dir):
    """Users as models with events as versions and purchases as promotions, as a registry document and back."""
    path, ev = _scratch(spark, "registry"), read(spark, sf_dir, "events").filter("user_id < 40")
    model, version = F.concat(F.lit("m"), "user_id"), F.concat(F.lit("v"), "event_id")
    versions = ev.select(model.alias("model"), version.alias("version"), F.lit("2024").alias("created_at"), F.col("event_type").alias("status"), F.create_map(F.lit("value"), F.col("value")).alias("metrics"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("tags"))
    promotions = ev.filter("event_type = 'purchase'").select(model.alias("model"), F.col("event_id").cast("int").alias("seq"), version.alias("version"), F.lit("staging").alias("stage"), F.lit("2024").alias("promoted_at"), F.lit(None).cast("string").alias("reason"))
    io.write_registry(versions, promotions, path)
    v, p = io.read_registry(spark, path)
    last = p.groupBy("model").agg(F.count(F.lit(1)).alias("n_promotions"), F.max_by("version", "seq").alias("promoted"))
    out = v.groupBy("model").agg(F.count(F.lit(1)).alias("n_versions"), F.max(F.col("metrics")["value"]).alias("best"), F.max(F.col("tags")["k"].cast("int")).alias("most_k"))
    return rounded(out.join(last, "model", "left"))


def src_history_tables(spark, sf_dir):
    """The history tables created, performance rows appended to one of them twice over, and read back."""
    database = f"fieldglass_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{_scratch(spark, 'database')}'")
    io.create_tables(spark, database)
    li = read(spark, sf_dir, "lineitem")
    runs = li.select(F.concat(F.lit("s"), "l_suppkey").alias("model_name"), F.col("l_quantity").cast("int").alias("batch_size"), F.col("l_extendedprice").alias("throughput"), F.create_map(F.lit("tax"), F.col("l_tax")).alias("parameters"))
    for part in (runs.filter("batch_size <= 25"), runs.filter("batch_size > 25")):
        io.append(part, "performance_metrics", database)
    kept = spark.table(f"{database}.performance_metrics")
    tax = F.get_json_object("parameters", "$.tax").cast("double")
    return rounded(kept.groupBy("model_name").agg(F.count(F.lit(1)).alias("n"), F.max("throughput").alias("best"), F.count("framework").alias("n_frameworks"), F.max(tax).alias("most_tax")))


def st_windowed_profile(spark, sf_dir):
    out = rounded(monitor.windowed_profile(read(spark, sf_dir, "events"), "ts", "value"))
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def st_category_drift(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    reference = profile.value_distribution(events, "event_type")
    out = rounded(monitor.batch_drift(monitor.windowed_categories(events, "ts", "event_type"), reference))
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def rel_pricing_summary(spark, sf_dir):
    """Not of the toolkit itself: pushed-down filter, wide aggregate."""
    li = read(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rounded(li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(price).alias("sum_price"), F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("n")), 2)


def rel_nation_revenue(spark, sf_dir):
    """Not of the toolkit itself: star join, the large side is shuffled at most once."""
    li, o, c, n = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    per_order = li.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    joined = o.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(joined.groupBy("n_name").agg(F.sum("rev").alias("revenue"), F.countDistinct("o_custkey").alias("n_customers")), 2)


NAMES = [n for n in dir() if n.startswith(("src_", "st_", "rel_"))]
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {
    "src_file_kinds": "SELECT 'parquet' AS kind, count(*) AS n_rows FROM documents",
    "src_int_keyed": "SELECT CAST(l_quantity AS INTEGER) AS batch_size, max(l_extendedprice) AS mean, CASE WHEN CAST(l_quantity AS INTEGER) % 2 = 1 THEN CAST(count(*) AS DOUBLE) END AS throughput FROM lineitem WHERE CAST(l_quantity AS INTEGER) <= 40 GROUP BY CAST(l_quantity AS INTEGER)",
    "src_array_files": "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 4) AS first, round(CAST(embedding[-1] AS DOUBLE), 4) AS last, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL",
    "src_validation_set": "SELECT l_returnflag AS target, count(*) AS n, round(sum(l_quantity), 6) AS quantity, max(l_discount) AS most FROM lineitem GROUP BY 1",
    "src_json_results": _completeness("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "src_registry_document": "SELECT 'm' || user_id AS model, count(*) AS n_versions, round(max(value), 6) AS best, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS most_k, nullif(count(*) FILTER (event_type = 'purchase'), 0) AS n_promotions, 'v' || max(event_id) FILTER (event_type = 'purchase') AS promoted FROM events WHERE user_id < 40 GROUP BY user_id",
    "src_history_tables": "SELECT 's' || l_suppkey AS model_name, count(*) AS n, max(l_extendedprice) AS best, CAST(0 AS BIGINT) AS n_frameworks, max(l_tax) AS most_tax FROM lineitem GROUP BY 1",
    "st_windowed_profile": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, count(*) AS n, count(*) - count(value) AS n_missing, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY 1",
    "st_category_drift": "WITH e AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type AS v FROM events WHERE event_type IS NOT NULL), c AS (SELECT start, v, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT start, sum(n) AS w FROM c GROUP BY 1), r AS (SELECT v, count(*) / (SELECT count(*) FROM e) AS s FROM e GROUP BY 1) SELECT t.start, round(sum(abs(coalesce(n, 0) / w - s)) / 2, 6) AS total_variation FROM t CROSS JOIN r LEFT JOIN c ON c.start = t.start AND c.v = r.v GROUP BY 1",
    "rel_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, round(avg(l_discount), 2) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "rel_nation_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_custkey) AS n_customers FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
}
