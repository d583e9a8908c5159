"""Registered advice queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass import reftables as ref
from fieldglass.operators import advice, security, textscan
from fieldglass.plans import rules
from fieldglass.plans.facts import derived, derived_sql
from fieldglass.plans.quality import read, rounded


#: What the operators take, for callers that make such tables by hand.
FOUND_SCHEMA = "pattern string, line int, function string"
RUNS_SCHEMA = "name string, big_o string, architecture string, memory_mb double, slowest_s double, source string"
MODELS_SCHEMA = "model string, params long, architecture string, heads int, layer_kinds array<string>, memory_mb double, framework string"
LOOPS_SCHEMA = "snippet_id string, line int, depth int, vectorizable boolean, reason string"
IMPORTS_SCHEMA = "snippet_id string, module string"
MEASURED_SCHEMA = "model string, bytes double, batch int"


def ad_pattern_advice(spark, sf_dir):
    return advice.pattern_advice(derived(spark, sf_dir, "found"))


def ad_framework_issues(spark, sf_dir):
    return advice.framework_issues(derived(spark, sf_dir, "code"))


def ad_compression_openings(spark, sf_dir):
    return advice.compression_openings(derived(spark, sf_dir, "code"))


def ad_platform_advice(spark, sf_dir):
    return advice.platform_advice(derived(spark, sf_dir, "code"))


def ad_technique_advice(spark, sf_dir):
    return advice.technique_advice(derived(spark, sf_dir, "code"))


def ad_instance_advice(spark, sf_dir):
    return advice.instance_advice(derived(spark, sf_dir, "code"))


def ad_robustness_advice(spark, sf_dir):
    """Score, attacks and summary of suppliers as models; results of an attack are their mean."""
    attacks = derived(spark, sf_dir, "attacks")
    by_attack = attacks.groupBy("model", "attack").agg(F.avg("robustness").alias("robustness"))
    return advice.robustness_advice(security.robustness(attacks), by_attack, security.robustness_details(attacks))


def ad_iso_times(spark, sf_dir):
    """ISO 8601 with seconds, as reports print times."""
    return read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


def ad_complexity_advice(spark, sf_dir):
    return advice.complexity_advice(derived(spark, sf_dir, "runs"))


def ad_model_advice(spark, sf_dir):
    return advice.model_advice(derived(spark, sf_dir, "advised_models"))


def ad_loop_advice(spark, sf_dir):
    return advice.loop_advice(derived(spark, sf_dir, "loops"), derived(spark, sf_dir, "imports"))


def ad_rule_suggestions(spark, sf_dir):
    return advice.rule_suggestions(rules.tx_regex_rules(spark, sf_dir), derived(spark, sf_dir, "evidence"))


def ad_tensor_core_share(spark, sf_dir):
    """Order lines stand for operations: a supplier's for a model's, even quantities could use tensor cores, cheap ones do."""
    ops = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") % 2 == 0).alias("eligible"), (F.col("l_extendedprice") < 20000).alias("used"))
    return rounded(advice.tensor_core_share(ops, "l_suppkey"))


def ad_top_bound_ops(spark, sf_dir):
    """Order lines stand for operations: a return flag's for a model's, in order of keys; discounts over 5 % are memory-bound."""
    line = read(spark, sf_dir, "lineitem")
    ops = line.select(F.col("l_returnflag").alias("model"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("pos"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("op"), F.when(F.col("l_discount") > 0.05, "memory").otherwise("compute").alias("bound"))
    return advice.top_bound_ops(ops)


def ad_human_bytes(spark, sf_dir):
    sizes = read(spark, sf_dir, "orders").select("o_orderkey", F.pow(F.floor("o_totalprice").cast("double"), F.col("o_orderkey") % 3 + 1).cast("long").alias("bytes"))
    return sizes.select("o_orderkey", advice.human_bytes(F.col("bytes")).alias("size"))


def ad_memory_sweep(spark, sf_dir):
    return rounded(advice.memory_sweep(derived(spark, sf_dir, "measured")), 1)


def ad_version_stamp(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", advice.version_stamp(F.col("ts")).alias("version"))


def ad_fingerprints(spark, sf_dir):
    """Order lines stand for layers, orders for models."""
    return advice.fingerprints(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("model"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("params")))


NAMES = [n for n in dir() if n.startswith("ad_")]
QUERIES = {n: globals()[n] for n in NAMES}

_v = ref.values_sql
_INFERRED = f"({rules._INFERRED})"
_HUMAN = "CASE WHEN b < 1024 THEN format('{{:.2f}} B', b) WHEN b < 1048576 THEN format('{{:.2f}} KB', b / 1024) WHEN b < 1073741824 THEN format('{{:.2f}} MB', b / 1048576) WHEN b < 1099511627776 THEN format('{{:.2f}} GB', b / 1073741824) ELSE format('{{:.2f}} TB', b / 1099511627776) END".replace("{{", "{").replace("}}", "}")


def _fired(source: str, key: str, *cases: tuple[str, str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{kind}' AS type, '{severity}' AS severity, '{text}' AS advice FROM {source} WHERE {on}" for on, kind, severity, text in cases)


ORACLES = {
    "ad_pattern_advice": f"WITH {derived_sql("found", "f")}, {_v(advice.PATTERN_ADVICE, advice.PATTERN_ADVICE_SCHEMA, 'p')} SELECT * FROM f JOIN p USING (pattern)",
    "ad_framework_issues": f"WITH {derived_sql("code", "x")}, {_v(advice.ISSUES, advice.ISSUES_SCHEMA, 'p')}, u AS (" + " UNION ALL ".join(f"SELECT snippet_id, '{n}' AS framework FROM x WHERE regexp_matches(code, {rules._q('(?i)' + t)})" for n, t in textscan.FRAMEWORKS) + ") SELECT snippet_id, framework, pattern, suggestion FROM x JOIN u USING (snippet_id) JOIN p USING (framework) WHERE regexp_matches(code, '(?i)' || pattern)",
    "ad_compression_openings": f"WITH {derived_sql("code", "x")}, {_v(advice.TOOLS, advice.TOOLS_SCHEMA, 't')}, i AS {_INFERRED}, o AS (SELECT i.snippet_id, technique, framework, implementation FROM i JOIN t ON i.name = t.framework WHERE kind = 'framework' UNION ALL SELECT snippet_id, technique, 'any', NULL FROM x CROSS JOIN (SELECT DISTINCT technique FROM t) WHERE snippet_id NOT IN (SELECT snippet_id FROM i WHERE kind = 'framework')) SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.snippet_id = o.snippet_id AND i.kind = 'compression' AND i.name = o.technique)",
    "ad_platform_advice": f"WITH {derived_sql("code", "x")}, {_v(advice.PLATFORM, advice.PLATFORM_SCHEMA, 'p')}, i AS {_INFERRED} SELECT snippet_id, kind, name, recommendation FROM (SELECT snippet_id, kind, name FROM i WHERE kind IN ('hardware', 'cloud') UNION ALL SELECT snippet_id, 'cloud', 'general' FROM x WHERE snippet_id NOT IN (SELECT snippet_id FROM i WHERE kind = 'cloud')) JOIN p USING (kind, name)",
    "ad_complexity_advice": f"WITH {derived_sql("runs", "r")} " + _fired(
        "r", "name",
        ("architecture <> 'unknown'", "architecture", "info", "architecture detected"),
        ("architecture = 'diffusion'", "optimization", "medium", "distil sampling steps, low-rank adapters, half precision"),
        ("architecture = 'diffusion' AND memory_mb > 50", "memory", "high", "smaller batches, checkpoint gradients"),
        ("big_o LIKE '%n^2%' OR big_o LIKE '%n^3%'", "complexity", "high", "find an algorithm of lower order"),
        ("big_o LIKE '%2^n%'", "complexity", "critical", "avoid exponential recursion"),
        ("memory_mb > 100", "memory", "medium", "process in smaller chunks"),
        ("slowest_s > 0.1", "hotspot", "medium", "optimize the slowest call"),
        ("big_o LIKE '%2^n%' AND source LIKE '%return%'", "optimization", "high", "memoize"),
        ("big_o LIKE '%n^%' AND source LIKE '%for%'", "optimization", "medium", "parallelize or vectorize the loops"),
    ),
    "ad_model_advice": f"WITH {derived_sql("advised_models", "m")} " + _fired(
        "m", "model",
        ("params > 10000000", "optimization", "high", "quantize"),
        ("architecture = 'Transformer'", "performance", "medium", "use an inference runtime"),
        ("architecture = 'Transformer' AND heads > 8", "architecture", "medium", "prune attention heads"),
        ("architecture = 'CNN' AND NOT coalesce(array_to_string(layer_kinds, ','), '') LIKE '%BatchNorm%'", "architecture", "medium", "add batch normalization"),
        ("memory_mb > 1024", "memory", "high", "checkpoint gradients, mixed precision or sharding"),
        ("framework = 'pytorch'", "deployment", "low", "export a compiled script"),
        ("framework = 'tensorflow'", "deployment", "low", "export to a tensor runtime"),
    ),
    "ad_loop_advice": f"WITH {derived_sql("loops", "l")}, {derived_sql("imports", "m")}, k AS (SELECT *, CASE WHEN reason ILIKE '%arithmetic%' THEN 1 WHEN reason ILIKE '%comprehension%' THEN 2 WHEN reason ILIKE '%iterating over numpy%' OR reason ILIKE '%pandas%' THEN 3 END AS kind FROM l) SELECT snippet_id, line, 'vectorization' AS type, CASE kind WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'high' END AS severity, CASE kind WHEN 1 THEN 'vectorize arithmetic' WHEN 2 THEN 'replace the comprehension' ELSE 'do not iterate over arrays or frames' END AS advice FROM k WHERE vectorizable AND kind IS NOT NULL UNION ALL SELECT snippet_id, min(line), 'vectorization', 'high', 'vectorize nested loops' FROM l WHERE depth > 1 GROUP BY 1 UNION ALL SELECT snippet_id, min(line), 'import', 'medium', 'import numpy' FROM l WHERE snippet_id NOT IN (SELECT snippet_id FROM m WHERE module = 'numpy') GROUP BY 1",
    "ad_rule_suggestions": f"WITH {derived_sql("evidence", "e")}, f AS ({rules.ORACLES['tx_regex_rules']}) SELECT snippet_id, array_to_string(list_transform(string_split(rule, '_'), lambda x: upper(x[1]) || x[2:]), ' ') AS title, severity, 1.0::DOUBLE AS confidence, CASE WHEN time_impact IS NULL AND memory_impact IS NULL THEN 'rule' ELSE 'profiler' END AS source, 'Rule-based detection: ' || rule || coalesce(chr(10) || format('Profiling evidence: {{:.1f}}x slower execution', time_impact), '') || coalesce(chr(10) || format('Memory impact: {{:.1f}}x higher memory usage', memory_impact), '') AS reason FROM f LEFT JOIN e USING (rule)".replace("{{", "{").replace("}}", "}"),
    "ad_tensor_core_share": "SELECT l_suppkey, round(coalesce(count(*) FILTER (l_quantity % 2 = 0 AND l_extendedprice < 20000) / nullif(count(*) FILTER (l_quantity % 2 = 0), 0), 0), 6) AS share FROM lineitem GROUP BY 1",
    "ad_top_bound_ops": "WITH o AS (SELECT l_returnflag AS model, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS pos, l_partkey || '-' || l_suppkey AS op, CASE WHEN l_discount > 0.05 THEN 'memory' ELSE 'compute' END AS bound FROM lineitem), b AS (SELECT model, CASE WHEN count(*) FILTER (bound = 'memory') > count(*) FILTER (bound = 'compute') THEN 'memory' ELSE 'compute' END AS bound FROM o GROUP BY 1) SELECT model, bound, pos, op FROM o JOIN b USING (model, bound) QUALIFY row_number() OVER (PARTITION BY model ORDER BY pos, op) <= 5",
    "ad_human_bytes": f"SELECT o_orderkey, {_HUMAN} AS size FROM (SELECT o_orderkey, CAST(CAST(pow(CAST(floor(o_totalprice) AS DOUBLE), o_orderkey % 3 + 1) AS BIGINT) AS DOUBLE) AS b FROM orders)",
    "ad_memory_sweep": f"WITH {derived_sql("measured", "m")} SELECT model, batch, round(b, 1) AS bytes, {_HUMAN} AS human FROM (SELECT model, t AS batch, f + t * (bytes - f) / greatest(coalesce(batch, 1), 1) AS b FROM (SELECT *, bytes * CASE WHEN batch > 1 THEN 0.2 ELSE 0.5 END AS f FROM m WHERE bytes IS NOT NULL), (SELECT unnest({list(advice.BATCHES)}) AS t))",
    "ad_version_stamp": "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS version FROM events",
    "ad_fingerprints": "SELECT l_orderkey AS model, md5(string_agg(coalesce(l_returnflag, '') || ':' || coalesce(CAST(l_partkey AS VARCHAR), ''), ',' ORDER BY l_linenumber, coalesce(l_returnflag, '') || ':' || coalesce(CAST(l_partkey AS VARCHAR), ''))) AS fingerprint FROM lineitem GROUP BY 1",
}
_A = derived_sql("attacks", "a")
ORACLES |= {
    "ad_technique_advice": f"WITH {_v(advice.TECHNIQUES, advice.TECHNIQUES_SCHEMA, 'q')} SELECT snippet_id, technique, recommendation FROM (SELECT DISTINCT snippet_id, technique FROM ({ORACLES['ad_compression_openings']})) JOIN q USING (technique)",
    "ad_instance_advice": f"WITH {_v(advice.INSTANCES, advice.INSTANCES_SCHEMA, 'q')} SELECT snippet_id, name, class, unnest(instances) AS instance FROM (SELECT * FROM {_INFERRED} WHERE kind = 'cloud') JOIN q USING (name)",
    "ad_iso_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events",
    "ad_robustness_advice": f"WITH {_A}, s AS (SELECT model, coalesce(avg(CASE WHEN original_accuracy = 0 THEN 0 ELSE adversarial_accuracy / original_accuracy END), 0) * 100 AS score, coalesce(avg(success_rate), 0) AS ok, coalesce(min(robustness), 1) AS worst, 1 - coalesce(stddev_pop(robustness), 0) AS even FROM a GROUP BY 1), b AS (SELECT model, attack, avg(robustness) AS r FROM a GROUP BY ALL) "
    + _fired("s", "model", ("true", "training", "info", "train on adversarial examples"), ("true", "ensemble", "info", "combine several models"), ("score < 30", "architecture", "high", "redesign for robustness"), ("score < 30", "training", "high", "defensive distillation"), ("score < 30", "input", "high", "preprocess inputs"),
             ("score >= 30 AND score < 60", "training", "medium", "regularize"), ("score >= 30 AND score < 60", "input", "medium", "squeeze features"), ("score >= 30 AND score < 60", "training", "medium", "mask gradients"), ("worst < 0.2", "worst case", "high", "train on the weakest attack"), ("even < 0.5", "consistency", "medium", "even out attacks"), ("ok > 0.7", "detection", "high", "detect adversarial examples"))
    + " UNION ALL " + _fired("b", "model", ("attack = 'fgsm' AND r < 0.5", "attack", "medium", "mask gradients against gradient attacks"), ("attack = 'pgd' AND r < 0.4", "attack", "medium", "train on projected gradient attacks"), ("attack = 'carlini_wagner' AND r < 0.3", "attack", "medium", "distil against optimization attacks"), ("attack = 'spatial_transformation' AND r < 0.6", "attack", "medium", "train on spatial transformations")),
}
