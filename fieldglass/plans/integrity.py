"""Registered queries of constraints, graphs, sweeps, cached results, histories and rule indexes, and their DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from fieldglass.functions.stages import shared_dir
from fieldglass.operators import cache, constraints, graph, ruleindex, sweep, textscan
from fieldglass.plans.quality import read, rounded
from fieldglass.streaming import history


def _scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/fieldglass/{label}-{uuid.uuid4().hex}"


# constraints: the tables with faults planted by their keys

ORDER_RULES = [
    {"name": "price in range", "kind": "range", "columns": ["o_totalprice"], "low": 1000.0, "high": 450_000.0},
    {"name": "date not before 1993", "kind": "range", "columns": ["o_orderdate"], "low": "1993-01-01"},
    {"name": "status known", "kind": "enum", "columns": ["o_orderstatus"], "allowed": ["F", "O", "P"]},
    {"name": "priority well formed", "kind": "pattern", "columns": ["o_orderpriority"], "pattern": r"[1-5]-[A-Z ]+"},
    {"name": "customer and status present", "kind": "not_null", "columns": ["o_custkey", "o_orderstatus"]},
    {"name": "order key unique", "kind": "key", "columns": ["o_orderkey"]},
    {"name": "customer exists", "kind": "foreign_key", "columns": ["o_custkey"], "reference": "customer", "target": ["c_custkey"]},
    {"name": "day decides status", "kind": "functional", "columns": ["o_custkey", "o_orderdate"], "determines": ["o_orderstatus"]},
]
LINE_RULES = [
    {"name": "line key unique", "kind": "key", "columns": ["l_orderkey", "l_linenumber"]},
    {"name": "order exists", "kind": "foreign_key", "columns": ["l_orderkey"], "reference": "orders", "target": ["o_orderkey"]},
    {"name": "supplier exists", "kind": "foreign_key", "columns": ["l_suppkey"], "reference": "supplier", "target": ["s_suppkey"]},
    {"name": "part decides quantity's price", "kind": "functional", "columns": ["l_partkey", "l_quantity"], "determines": ["l_extendedprice"]},
    {"name": "discount in range", "kind": "range", "columns": ["l_discount"], "low": 0.0, "high": 0.09},
]


def _faulty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    every = lambda n, k=0: F.col("o_orderkey") % n == k
    return o.select(
        F.when(every(101), F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("o_orderkey"), F.when(every(97), None).when(every(89), F.col("o_custkey") + 1_000_000_000).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(every(83), "X").when(every(79), None).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(every(73), float("nan")).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.col("o_orderdate").cast("date").alias("o_orderdate"),
        F.when(every(71), F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"), F.col("o_orderkey").alias("row_id"))


def dq_constraints(spark, sf_dir):
    refs = {t: read(spark, sf_dir, t) for t in ("customer", "supplier")} | {"orders": read(spark, sf_dir, "orders").filter("o_orderkey % 50 <> 7")}
    orders = constraints.violations(_faulty_orders(spark, sf_dir), ORDER_RULES, refs).withColumn("table_name", F.lit("orders"))
    return orders.unionByName(constraints.violations(read(spark, sf_dir, "lineitem"), LINE_RULES, refs).withColumn("table_name", F.lit("lineitem")))


def dq_constraint_rows(spark, sf_dir):
    return constraints.violating_rows(_faulty_orders(spark, sf_dir), ORDER_RULES, ["row_id"], {"customer": read(spark, sf_dir, "customer")})


_FAULTY = """o AS (SELECT CASE WHEN o_orderkey % 101 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 83 = 0 THEN 'X' WHEN o_orderkey % 79 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 73 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
  CASE WHEN o_orderkey % 71 = 0 THEN o_orderpriority || '!' ELSE o_orderpriority END AS o_orderpriority, o_orderkey AS row_id FROM orders),
b AS (SELECT 'price in range' AS rule, row_id FROM o WHERE o_totalprice < 1000 OR o_totalprice > 450000
  UNION ALL SELECT 'date not before 1993', row_id FROM o WHERE o_orderdate < DATE '1993-01-01'
  UNION ALL SELECT 'status known', row_id FROM o WHERE o_orderstatus NOT IN ('F', 'O', 'P')
  UNION ALL SELECT 'priority well formed', row_id FROM o WHERE NOT regexp_full_match(o_orderpriority, '[1-5]-[A-Z ]+')
  UNION ALL SELECT 'customer and status present', row_id FROM o WHERE o_custkey IS NULL OR o_orderstatus IS NULL
  UNION ALL SELECT 'order key unique', row_id FROM (SELECT row_id, count(*) OVER (PARTITION BY o_orderkey) AS n FROM o WHERE o_orderkey IS NOT NULL) WHERE n > 1
  UNION ALL SELECT 'customer exists', row_id FROM o WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'day decides status', row_id FROM (SELECT row_id, min(coalesce(o_orderstatus, '')) OVER g <> max(coalesce(o_orderstatus, '')) OVER g AS bad FROM o WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL WINDOW g AS (PARTITION BY o_custkey, o_orderdate)) WHERE bad)"""
_LINES = {
    "line key unique": "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    "order exists": "SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 7)",
    "supplier exists": "SELECT count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)",
    "part decides quantity''s price": "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_quantity HAVING min(l_extendedprice) <> max(l_extendedprice))",
    "discount in range": "SELECT count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 0.09",
}


# graph: a purchase calls the error that follows it under the same key and day; users are the nodes


def gr_recursion_groups(spark, sf_dir):
    ev = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    follow = Window.partitionBy("k", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    calls = ev.select("user_id", "event_type", F.lead("user_id").over(follow).alias("next_user"), F.lead("event_type").over(follow).alias("next_type"))
    return graph.strong_components(calls.filter("event_type in ('purchase', 'view') and next_type = 'error'"), "user_id", "next_user")


# sweep: quantities between order and shipment, by supplier


def ms_peak_alive(spark, sf_dir):
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    held = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(sweep.peaks(held, ["l_suppkey"], F.col("o_orderdate"), F.col("l_shipdate"), F.col("l_quantity")))


# results that are kept by group: one supplier's rows change, one supplier goes, nothing changes


def inc_supplier_refresh(spark, sf_dir):
    path, li = _scratch(spark, "suppliers"), read(spark, sf_dir, "lineitem")
    totals = lambda rows: rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    changed = li.filter("l_suppkey <> 3").withColumn("l_quantity", F.when(F.col("l_suppkey") == 1, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    runs = [cache.refresh(rows, ["l_suppkey"], totals, path) for rows in (li, changed, changed.repartition("l_orderkey"))]  # the last has the same rows, dealt anew
    counts = spark.createDataFrame([(i, r.version, r.n_computed, r.n_removed) for i, r in enumerate(runs, 1)], "run int, at_version int, n_computed long, n_removed long")
    return rounded(runs[-1].result.withColumn("run", F.lit(3)).join(F.broadcast(counts), "run").select("l_suppkey", "n", "quantity", "version", "at_version", "n_computed", "n_removed"))


# history: events arrive in pieces, one piece arrives twice


def st_history_append(spark, sf_dir):
    events, base = read(spark, sf_dir, "events"), _scratch(spark, "history")
    events.repartitionByRange(4, "event_id").write.parquet(f"{base}/pieces")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/pieces")
    history.record(stream, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    history.append_once(f"{base}/table")(events.limit(0), 1)  # a replayed batch adds and removes nothing
    kept = history.read_history(spark, f"{base}/table")
    return rounded(kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_events"), F.max("value").alias("max_value")))


# rule indexes: all phrases of three words of the benchmark in all documents; the rules on models in all pages


def _phrase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    phrases = read(spark, sf_dir, "benchmark").select("text", words.alias("w")).filter(F.size("w") >= 3)
    three = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.slice("w", i + 1, 3))
    quoted = lambda w: F.regexp_replace(w, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    ends = r"[\x20\x09-\x0D]"
    rule = phrases.select(F.explode(three).alias("p")).select(F.array_join("p", " ").alias("rule"), F.array_join(F.transform("p", quoted), f"{ends}+").alias("body"))
    return rule.distinct().select("rule", F.concat(F.lit(f"(?:^|{ends})"), "body", F.lit(f"(?:{ends}|$)")).alias("pattern"), F.lit(None).cast("string").alias("unless"))


def tx_rule_index_documents(spark, sf_dir):
    return ruleindex.match_rules(read(spark, sf_dir, "documents"), _phrase_rules(spark, sf_dir), "doc_id", "text")


#: Patterns of the tables of architectures, algorithms, frameworks, hardware and clouds, in any letter case.
KNOWN_RULES = [(f"{kind}: {name}: {i}", f"(?i){p}", None) for kind, table in (("architecture", textscan.ARCHITECTURES), ("algorithm", textscan.ALGORITHMS)) for name, ps in table for i, p in enumerate(ps)] + [
    (f"{kind}: {name}", f"(?i){p}", "(?i)nothing else" if name == "AWS" else None) for kind, table in (("framework", textscan.FRAMEWORKS), ("hardware", textscan.HARDWARE), ("cloud", textscan.CLOUDS), ("compression", textscan.COMPRESSION)) for name, p in table
]


def tx_rule_index_pages(spark, sf_dir):
    rules = spark.createDataFrame(KNOWN_RULES, "rule string, pattern string, unless string")
    return ruleindex.match_rules(read(spark, sf_dir, "pages"), rules, "page_id", "html")


NAMES = "dq_constraints dq_constraint_rows gr_recursion_groups ms_peak_alive inc_supplier_refresh st_history_append tx_rule_index_documents tx_rule_index_pages".split()
QUERIES = {n: globals()[n] for n in NAMES}


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


ORACLES = {
    "dq_constraints": f"WITH {_FAULTY} SELECT 'orders' AS table_name, r.rule, count(row_id) AS n_violations FROM (VALUES " + ", ".join(f"('{r['name']}')" for r in ORDER_RULES) + ") r(rule) LEFT JOIN b USING (rule) GROUP BY ALL UNION ALL " + " UNION ALL ".join(f"SELECT 'lineitem', '{n}', CAST(({q}) AS BIGINT)" for n, q in _LINES.items()),
    "dq_constraint_rows": f"WITH {_FAULTY} SELECT rule, row_id FROM b",
    "gr_recursion_groups": """WITH RECURSIVE s AS (SELECT user_id, event_type, lead(user_id) OVER w AS next_user, lead(event_type) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY json_extract_string(props, '$.k'), date_trunc('day', ts) ORDER BY ts, event_id)),
      e AS (SELECT DISTINCT user_id AS a, next_user AS b FROM s WHERE event_type IN ('purchase', 'view') AND next_type = 'error' AND user_id IS NOT NULL AND next_user IS NOT NULL),
      reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
      node AS (SELECT a AS node FROM e UNION SELECT b FROM e), mate AS (SELECT x.a AS node, x.b AS other FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a UNION SELECT node, node FROM node),
      named AS (SELECT node, min(other) AS component FROM mate GROUP BY node)
      SELECT node, component, count(*) OVER (PARTITION BY component) AS size, node IN (SELECT a FROM reach WHERE a = b) AS recursive FROM named""",
    "ms_peak_alive": """WITH i AS (SELECT l_suppkey, o_orderdate AS s, l_shipdate AS e, l_quantity AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate), m AS (SELECT l_suppkey, t, sum(d) AS d FROM (SELECT l_suppkey, s AS t, w AS d FROM i UNION ALL SELECT l_suppkey, e, -w FROM i) GROUP BY ALL),
      a AS (SELECT l_suppkey, t, sum(d) OVER (PARTITION BY l_suppkey ORDER BY t) AS alive FROM m) SELECT l_suppkey, round(max(alive), 6) AS peak, arg_min(t, (-alive, t)) AS peak_at, count(*) AS n_moments FROM a GROUP BY 1""",
    "inc_supplier_refresh": "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity + (l_suppkey = 1)::INT), 6) AS quantity, CASE WHEN l_suppkey = 1 THEN 2 ELSE 1 END AS version, CAST(2 AS INTEGER) AS at_version, CAST(0 AS BIGINT) AS n_computed, CAST(0 AS BIGINT) AS n_removed FROM lineitem WHERE l_suppkey <> 3 GROUP BY 1",
    "st_history_append": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_events, round(max(value), 6) AS max_value FROM events GROUP BY 1",
    "tx_rule_index_documents": r"""WITH p AS (SELECT DISTINCT array_to_string(w[i:i+2], ' ') AS rule FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark))),
      d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS rule FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents))) SELECT doc_id, rule FROM d SEMI JOIN p USING (rule)""",
    "tx_rule_index_pages": "WITH r(rule, pattern, unless) AS (VALUES " + ", ".join(f"({_text(a)}, {_text(p)}, {_text(u)})" for a, p, u in KNOWN_RULES) + ") SELECT DISTINCT page_id, rule FROM pages, r WHERE regexp_matches(html, pattern) AND (unless IS NULL OR NOT regexp_matches(html, unless))",
}
