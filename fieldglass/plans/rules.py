"""Registered rule, score, cost, roofline and code-scan queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass import reftables as ref
from fieldglass.operators import codescan, cost, roofline, security, textscan
from fieldglass.plans.facts import derived, derived_sql
from fieldglass.plans.quality import read, rounded

GATES_SCHEMA = "metric string, direction string, threshold double"
GATES = [("size_mb", "max", 100.0), ("latency_ms", "max", 50.0), ("reduction", "min", 0.3), ("security", "min", 70.0), ("robustness", "min", 40.0)]


def sc_vulnerabilities(spark, sf_dir):
    return security.findings(derived(spark, sf_dir, "models"), ref.risks(spark, more=True))


def sc_severity_counts(spark, sf_dir):
    return security.severity_counts(derived(spark, sf_dir, "models"), security.findings(derived(spark, sf_dir, "models"), ref.risks(spark)))


def sc_security_score(spark, sf_dir):
    return security.security_score(sc_severity_counts(spark, sf_dir))


def sc_enhanced_score(spark, sf_dir):
    counts = security.severity_counts(derived(spark, sf_dir, "models"), security.findings(derived(spark, sf_dir, "models"), ref.risks(spark, more=True)))
    return security.security_score(counts, (25, 15, 7, 3))


def sc_robustness(spark, sf_dir):
    return rounded(security.robustness(derived(spark, sf_dir, "attacks")))


def sc_weighted_robustness(spark, sf_dir):
    return rounded(security.weighted_robustness(derived(spark, sf_dir, "attacks")))


def sc_robustness_details(spark, sf_dir):
    return rounded(security.robustness_details(derived(spark, sf_dir, "attacks")))


def sc_gates(spark, sf_dir):
    return security.gates(derived(spark, sf_dir, "gated"), spark.createDataFrame(GATES, GATES_SCHEMA))


def co_instance_rank(spark, sf_dir):
    return rounded(cost.recommend(derived(spark, sf_dir, "prices"), derived(spark, sf_dir, "fleet"), 16.0, cost=0.5, performance=0.3, memory=0.2))


def co_instance_scores(spark, sf_dir):
    return rounded(cost.instance_scores(derived(spark, sf_dir, "prices"), 1.0).select("provider", "instance", "cost_score", "performance_score", "memory_score", "score"))


def co_top_alternatives(spark, sf_dir):
    return cost.top_alternatives(co_instance_rank(spark, sf_dir)).select("name", "rank", "instance", "cost")


def co_comparison(spark, sf_dir):
    return rounded(cost.comparison(co_instance_rank(spark, sf_dir), derived(spark, sf_dir, "prices")))


def co_cost_breakdown(spark, sf_dir):
    return rounded(cost.cost_breakdown(co_instance_rank(spark, sf_dir)))


def co_validated_results(spark, sf_dir):
    return cost.validated_results(derived(spark, sf_dir, "results"))


def rf_inference_time(spark, sf_dir):
    """Operations in thousands of millions, so that times are seconds."""
    layers = derived(spark, sf_dir, "layers").withColumn("flops", F.col("flops") * 1e9)
    return rounded(roofline.inference_time(layers))


def co_provision_class(spark, sf_dir):
    return derived(spark, sf_dir, "fleet").select("name", cost.provisioning(F.col("gpu_util"), F.col("memory_util")).alias("provisioning"))


def co_pricing_advice(spark, sf_dir):
    return rounded(cost.pricing_advice(derived(spark, sf_dir, "prices").select("provider", F.col("instance").alias("name"), "cost")))


def co_forecast(spark, sf_dir):
    return rounded(cost.forecast(derived(spark, sf_dir, "prices"), 8.0))


def co_serverless(spark, sf_dir):
    return rounded(cost.serverless(derived(spark, sf_dir, "loads")))


def co_best_ratio(spark, sf_dir):
    return rounded(cost.best_ratio(derived(spark, sf_dir, "prices").withColumn("throughput", F.coalesce("gpus", F.lit(1)) * 100.0)))


def co_parallelism(spark, sf_dir):
    return cost.parallelism(derived(spark, sf_dir, "sizes")).select("model", "strategy")


def co_applicable_strategies(spark, sf_dir):
    return cost.applicable_strategies(derived(spark, sf_dir, "sizes"))


def co_rank_strategies(spark, sf_dir):
    return cost.rank_strategies(derived(spark, sf_dir, "results"))


def co_loader_advice(spark, sf_dir):
    return cost.loader_advice(derived(spark, sf_dir, "sweep"))


def co_hardware_advice(spark, sf_dir):
    return cost.hardware_advice(derived(spark, sf_dir, "hosts"))


def rf_device_specs(spark, sf_dir):
    return roofline.device_specs(derived(spark, sf_dir, "devices"), ref.gpus(spark))


def rf_roofline(spark, sf_dir):
    """Efficiency in parts per billion, as the derived operations are small."""
    found = roofline.roofline(derived(spark, sf_dir, "ops"), rf_device_specs(spark, sf_dir))
    return rounded(found.withColumn("efficiency_ppb", F.col("efficiency") * 1e9).drop("efficiency"))


def rf_bottleneck(spark, sf_dir):
    return roofline.bottleneck(rf_roofline(spark, sf_dir))


def rf_layer_bottleneck(spark, sf_dir):
    return rounded(roofline.layer_bottlenecks(derived(spark, sf_dir, "layers")).select("model", "pos", "share_so_far"))


def rf_layer_rollup(spark, sf_dir):
    return rounded(roofline.layer_rollup(derived(spark, sf_dir, "layers")))


def rf_layer_params(spark, sf_dir):
    return roofline.layer_params(derived(spark, sf_dir, "layers")).select("model", "pos", "n_params")


def vc_alignment(spark, sf_dir):
    rows = derived(spark, sf_dir, "shapes")
    return rounded(rows.select("line", "op", roofline.alignment(F.col("shapes"), F.col("op"), F.col("gpu")).alias("efficiency"), roofline.tensor_core(F.col("shapes"), F.col("op"), F.col("capability")).alias("tensor_core")))


def vc_flops_and_bytes(spark, sf_dir):
    rows = derived(spark, sf_dir, "shapes")
    return rounded(rows.select("line", "op", roofline.shape_bytes(F.col("shapes")).alias("bytes"), roofline.op_flops(F.col("op"), F.try_element_at("shapes", F.lit(1)), F.col("out_features")).alias("flops")))


def tx_regex_rules(spark, sf_dir):
    return textscan.apply_rules(derived(spark, sf_dir, "code"), spark.createDataFrame(textscan.RULES, textscan.RULES_SCHEMA))


def tx_severe_rules(spark, sf_dir):
    return textscan.apply_rules(derived(spark, sf_dir, "code"), spark.createDataFrame(textscan.RULES, textscan.RULES_SCHEMA), "medium", ("append_in_loop",), 1).select("snippet_id", "rule")


def tx_architecture_vote(spark, sf_dir):
    return textscan.architecture_vote(derived(spark, sf_dir, "code"))


def tx_pattern_scan(spark, sf_dir):
    return textscan.known_patterns(derived(spark, sf_dir, "code"))


def tx_recognize(spark, sf_dir):
    return textscan.recognize(derived(spark, sf_dir, "code"))


def tx_inferred(spark, sf_dir):
    return textscan.inferred(derived(spark, sf_dir, "code"))


def tx_aligned(spark, sf_dir):
    return textscan.aligned(derived(spark, sf_dir, "code"))


def tx_settings(spark, sf_dir):
    return textscan.settings(derived(spark, sf_dir, "code"))


def tx_keyword_overlap(spark, sf_dir):
    return rounded(textscan.keyword_overlap(derived(spark, sf_dir, "words_a"), derived(spark, sf_dir, "words_b")))


def tx_conversations(spark, sf_dir):
    """The vote over real texts: conversation turns."""
    turns = read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("snippet_id"), F.coalesce("text", F.lit("")).alias("code"))
    return textscan.architecture_vote(turns).groupBy("architecture").agg(F.count(F.lit(1)).alias("n"), F.sum("votes").alias("votes"))


def cs_code_facts(spark, sf_dir):
    found = codescan.scan(derived(spark, sf_dir, "scripts"))
    return found.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in found.dtypes])


def cs_call_frequency(spark, sf_dir):
    return codescan.scan(derived(spark, sf_dir, "scripts")).select(F.explode("calls").alias("call")).groupBy("call").agg(F.count(F.lit(1)).alias("n"))


NAMES = [n for n in dir() if n.startswith(("sc_", "co_", "rf_", "vc_", "tx_", "cs_"))]
QUERIES = {n: globals()[n] for n in NAMES}

_v = ref.values_sql
_MODELS = derived_sql("models", "m")


def _findings(rules) -> str:
    return f"""WITH {_MODELS}, {_v(rules, ref.RISKS_SCHEMA, 'r')}
SELECT model, type, name, severity, cve FROM m JOIN r ON CASE field
  WHEN 'architecture contains' THEN contains(lower(coalesce(architecture, '')), wanted)
  WHEN 'architecture any' THEN regexp_matches(lower(coalesce(architecture, '')), wanted)
  WHEN 'technique' THEN coalesce(list_contains(techniques, wanted), false)
  WHEN 'framework version' THEN lower(framework) || ' ' || framework_version = wanted
  WHEN 'deployment' THEN lower(deployment) = wanted
  WHEN 'source' THEN source = wanted
  WHEN 'api exposed' THEN api_exposed
  WHEN 'serialization' THEN serialization = wanted
  WHEN 'container' THEN container
  WHEN 'parameters over' THEN coalesce(parameters, 0) > try_cast(wanted AS BIGINT) ELSE false END"""


def _counts(rules) -> str:
    return f"SELECT model, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(severity) AS total FROM (WITH {_MODELS} SELECT model FROM m) LEFT JOIN ({_findings(rules)}) USING (model) GROUP BY model"


_BAND = "CASE WHEN s < 20 THEN 'very low' WHEN s < 40 THEN 'low' WHEN s < 60 THEN 'medium' WHEN s < 80 THEN 'high' ELSE 'very high' END AS level"
_ATT = derived_sql("attacks", "a")
_WEIGHT = "CASE attack " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in ref.ATTACK_WEIGHTS.items()) + " END"
_PRICES = derived_sql("prices", "p")
_PROV = "CASE WHEN coalesce(gpu_util, 0.5) < 0.7 AND coalesce(memory_util, 0.5) < 0.7 THEN 'over' WHEN coalesce(gpu_util, 0.5) > 0.9 OR coalesce(memory_util, 0.5) > 0.9 THEN 'under' ELSE 'right' END"


def _scores(c: float, g: float, m: float) -> str:
    return f"SELECT *, cost_score * {c} + performance_score * {g} + memory_score * {m} AS score FROM (SELECT *, 1 - cost / max(cost) OVER (PARTITION BY provider) AS cost_score, CASE gpu_type WHEN 'A100' THEN 1.0 WHEN 'V100' THEN 0.8 WHEN 'A10G' THEN 0.7 WHEN 'T4' THEN 0.5 ELSE 0 END * least(coalesce(gpus, 1) / 8.0, 1.0) AS performance_score, CAST(ram AS DOUBLE) / max(ram) OVER (PARTITION BY provider) AS memory_score FROM p)"


_CODE = derived_sql("code", "c")
_RULES = _v(textscan.RULES, textscan.RULES_SCHEMA, "r")
_RANKED = "list_position(['low', 'medium', 'high', 'critical'], severity)"


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _vote(source: str) -> str:
    votes = ", ".join(f"{{'v': {' + '.join(f'''len(regexp_extract_all(code, {_q('(?i)' + p)}))''' for p in ps)}, 'i': {-i}, 'name': '{n}'}}" for i, (n, ps) in enumerate(textscan.ARCHITECTURES))
    return f"SELECT snippet_id, CASE WHEN b.v > 0 THEN b.name ELSE 'unknown' END AS architecture, CAST(b.v AS BIGINT) AS votes FROM (SELECT snippet_id, list_max([{votes}]) AS b FROM ({source}))"


def _infer(kind: str, table) -> str:
    return " UNION ALL ".join(f"SELECT snippet_id, '{kind}' AS kind, '{n}' AS name, {i} AS i FROM c WHERE regexp_matches(code, {_q('(?i)' + p)})" for i, (n, p) in enumerate(table))


_INFERRED = f"WITH {_CODE}, f AS ({_infer('framework', textscan.FRAMEWORKS)}), h AS ({_infer('hardware', textscan.HARDWARE)}), k AS ({_infer('cloud', textscan.CLOUDS)}), z AS ({_infer('compression', textscan.COMPRESSION)}) SELECT snippet_id, kind, name FROM f UNION ALL SELECT snippet_id, kind, name FROM h UNION ALL SELECT snippet_id, 'hardware', 'CPU' FROM c WHERE snippet_id NOT IN (SELECT snippet_id FROM h) UNION ALL SELECT snippet_id, kind, arg_min(name, i) FROM k GROUP BY ALL UNION ALL SELECT snippet_id, kind, name FROM z"
_RECOGNIZED = f"WITH {_CODE} SELECT snippet_id, algorithm, n_matched, CAST(least(80, 40 + 10 * n_matched) AS INTEGER) AS confidence FROM (" + " UNION ALL ".join(f"SELECT snippet_id, '{n}' AS algorithm, CAST({' + '.join(f'''CAST(regexp_matches(code, {_q('(?i)' + p)}) AS INTEGER)''' for p in ps)} AS INTEGER) AS n_matched FROM c" for n, ps in textscan.ALGORITHMS) + ") WHERE n_matched > 0"
_SPECS = f"WITH {derived_sql("devices", "d")}, {_v(ref.GPUS, ref.GPUS_SCHEMA, 'g')} SELECT device, coalesce(arg_min(tflops, pos), 10.0) AS tflops, coalesce(arg_min(gbps, pos), 500.0) AS gbps, arg_min(architecture, pos) AS architecture FROM d LEFT JOIN g ON contains(device, gpu) GROUP BY device"
_ROOF = f"WITH {derived_sql("ops", "o")} SELECT model, op, round(intensity, 6) AS intensity, round(achieved, 6) AS achieved, round(achieved / (tflops * 1e12) * 1e9, 6) AS efficiency_ppb, CASE WHEN intensity < tflops * 1e12 / (gbps * 1e9) THEN 'memory' ELSE 'compute' END AS bound FROM (SELECT *, flops / CASE WHEN bytes > 0 THEN bytes ELSE time_us * 1e-3 END AS intensity, flops / (time_us * 1e-6) AS achieved FROM o JOIN ({_SPECS}) USING (device) WHERE time_us >= 1)"

ORACLES = {
    "sc_vulnerabilities": _findings(ref.RISKS + ref.MORE_RISKS),
    "sc_severity_counts": _counts(ref.RISKS),
    "sc_security_score": f"SELECT model, CAST(greatest(0, least(100, 100 - 20 * critical - 10 * high - 5 * medium - 2 * low)) AS BIGINT) AS score FROM ({_counts(ref.RISKS)})",
    "sc_enhanced_score": f"SELECT model, CAST(greatest(0, least(100, 100 - 25 * critical - 15 * high - 7 * medium - 3 * low)) AS BIGINT) AS score FROM ({_counts(ref.RISKS + ref.MORE_RISKS)})",
    "sc_robustness": f"WITH {_ATT} SELECT model, round(s, 6) AS score, {_BAND} FROM (SELECT model, coalesce(avg(CASE WHEN original_accuracy = 0 THEN 0 ELSE adversarial_accuracy / original_accuracy END), 0) * 100 AS s FROM a GROUP BY 1)",
    "sc_weighted_robustness": f"WITH {_ATT} SELECT model, round(s, 6) AS score, {_BAND} FROM (SELECT model, coalesce(sum(coalesce({_WEIGHT}, 0.1) * robustness), 0) / CASE WHEN sum(coalesce({_WEIGHT}, 0)) = 0 THEN 1 ELSE sum(coalesce({_WEIGHT}, 0)) END * 100 AS s FROM a GROUP BY 1)",
    "sc_robustness_details": f"WITH {_ATT} SELECT model, round(coalesce(avg(perturbation), 0), 6) AS avg_perturbation, round(coalesce(avg(success_rate), 0), 6) AS avg_success, round(coalesce(min(robustness), 1), 6) AS worst_case, round(1 - coalesce(stddev_pop(robustness), 0), 6) AS consistency, count(*) AS n_attacks FROM a GROUP BY 1",
    "sc_gates": f"WITH {derived_sql("gated", "m")}, {_v(GATES, GATES_SCHEMA, 'g')} SELECT model, metric AS gate FROM m JOIN g USING (metric) WHERE CASE direction WHEN 'max' THEN value > threshold ELSE value < threshold END",
    "co_instance_rank": f"WITH {_PRICES}, {derived_sql("fleet", "f")}, s AS ({_scores(0.5, 0.3, 0.2)}), own AS (SELECT f.name, f.provider, f.instance AS current, p.cost AS current_cost, {_PROV} AS provisioning FROM f JOIN p ON f.provider = p.provider AND f.instance = p.instance) SELECT name, provisioning, current, current_cost, instance, cost, round((cost - current_cost) / current_cost * 100, 6) AS change_percent, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY name ORDER BY round(score, 12) DESC, instance) AS INTEGER) AS rank FROM own JOIN s USING (provider) WHERE instance <> current AND ram >= 16 AND (provisioning = 'over' AND cost < current_cost OR provisioning = 'under' AND cost > current_cost)",
    "co_instance_scores": f"WITH {_PRICES} SELECT provider, instance, round(cost_score, 6) AS cost_score, round(performance_score, 6) AS performance_score, round(memory_score, 6) AS memory_score, round(score, 6) AS score FROM ({_scores(1.0, 0.0, 0.0)})",
    "co_provision_class": f"WITH {derived_sql("fleet", "f")} SELECT name, {_PROV} AS provisioning FROM f",
    "co_pricing_advice": f"WITH {_PRICES} SELECT instance AS name, k AS model, round(cost * s, 6) AS savings_per_hour FROM p, (VALUES ('spot', 0.7), ('reserved_1yr', 0.4)) o(k, s) WHERE provider = 'aws'",
    "co_forecast": f"WITH {_PRICES} SELECT provider, instance, 240.0::DOUBLE AS hours, round(cost * 240, 6) AS monthly, round(cost * 240 * 0.6, 6) AS monthly_1yr, round(cost * 240 * 0.4, 6) AS monthly_3yr, round(cost * 240 * 12, 6) AS annual, round(cost * 240 * 0.6 * 12, 6) AS annual_1yr, round(cost * 240 * 0.4 * 12, 6) AS annual_3yr FROM p",
    "co_serverless": f"WITH {derived_sql("loads", "l")}, x AS (SELECT name, greatest(0.001, coalesce(latency_s, 0.001)) AS s, greatest(0.128, greatest(134217728.0, coalesce(peak_bytes, 0)) / 1073741824) AS gb, CAST(requests AS DOUBLE) AS n FROM l), y AS (SELECT name, 'aws' AS provider, n * gb * s * 0.0000166667 AS c FROM x UNION ALL SELECT name, 'gcp', 0.40 * n / 1e6 + 0.00001 * s * n + 0.0000025 * gb * s * n FROM x UNION ALL SELECT name, 'azure', 0.20 * n / 1e6 + 0.000016 * gb * s * n FROM x) SELECT name, provider, round(c, 6) AS monthly_cost, CAST(row_number() OVER (PARTITION BY name ORDER BY c, provider) AS INTEGER) AS rank, round((c / greatest(0.0001, min(c) OVER (PARTITION BY name)) - 1) * 100, 6) AS pct_above_best FROM y",
    "co_best_ratio": f"WITH {_PRICES} SELECT provider, instance, round(coalesce(gpus, 1) * 100.0 / cost, 6) AS throughput_per_cost FROM p ORDER BY coalesce(gpus, 1) * 100.0 / cost DESC, instance DESC LIMIT 1",
    "co_parallelism": f"WITH {derived_sql("sizes", "m")} SELECT model, CASE WHEN parameters < 1e9 THEN 'data parallel' WHEN parameters < 1e10 THEN 'sharded data parallel' ELSE 'data, model and pipeline parallel' END AS strategy FROM m",
    "co_applicable_strategies": f"WITH {derived_sql("sizes", "m")} SELECT model, 'data parallel' AS strategy FROM m UNION ALL SELECT model, 'sharded data parallel' FROM m WHERE size_gb / device_gb > 0.3 UNION ALL SELECT model, 'pipeline parallel' FROM m WHERE size_gb / device_gb > 0.7",
    "co_rank_strategies": f"WITH {derived_sql("results", "m")} SELECT strategy, throughput, memory_gb, CAST(rank() OVER (ORDER BY throughput DESC) AS INTEGER) AS throughput_rank, CAST(rank() OVER (ORDER BY memory_gb) AS INTEGER) AS memory_rank FROM m WHERE throughput > 0 AND memory_gb IS NOT NULL",
    "co_loader_advice": f"WITH {derived_sql("sweep", "s")}, t AS (SELECT *, max(throughput) OVER (PARTITION BY loader, dimension) AS most FROM s), w AS (SELECT loader, framework, min(setting) AS value FROM t WHERE dimension = 'workers' AND throughput >= 0.95 * most GROUP BY ALL) SELECT loader, 'batch_size' AS kind, min(setting) AS value FROM t WHERE dimension = 'batch_size' AND throughput = most GROUP BY loader UNION ALL SELECT loader, 'num_workers', value FROM w WHERE value > 0 UNION ALL SELECT loader, 'pin_memory', 1 FROM w WHERE value > 0 AND framework = 'pytorch' UNION ALL SELECT DISTINCT loader, 'prefetch', 1 FROM s WHERE framework = 'tensorflow'",
    "co_hardware_advice": f"WITH {derived_sql("hosts", "h")} SELECT host, greatest(1, least(cores - 1, 16)) AS workers, CASE WHEN device_gb IS NULL THEN 'fp32' WHEN capability >= 8 THEN 'bf16' WHEN capability >= 7 THEN 'fp16' ELSE 'fp32' END AS precision, CAST(CASE WHEN floor(device_gb * 0.8 * 1024 / sample_mb) >= 1 THEN pow(2, floor(log2(floor(device_gb * 0.8 * 1024 / sample_mb)))) ELSE 1 END AS BIGINT) AS batch_size FROM h",
    "rf_device_specs": _SPECS,
    "rf_roofline": _ROOF,
    "rf_bottleneck": f"SELECT model, count(*) FILTER (bound = 'memory') AS n_memory, count(*) FILTER (bound = 'compute') AS n_compute, CASE WHEN count(*) FILTER (bound = 'memory') > count(*) FILTER (bound = 'compute') THEN 'memory' ELSE 'compute' END AS bottleneck FROM ({_ROOF}) GROUP BY model",
    "rf_layer_bottleneck": f"WITH {derived_sql("layers", "l")} SELECT model, pos, round(s, 6) AS share_so_far FROM (SELECT model, pos, flops / sum(flops) OVER (PARTITION BY model ORDER BY pos) AS s FROM l) WHERE s > 0.3",
    "rf_layer_rollup": f"WITH {derived_sql("layers", "l")} SELECT model, kind, count(*) AS n, CAST(sum(params) AS BIGINT) AS params, round(sum(params) * 4 / 1048576.0, 6) AS size_mb, round(sum(flops), 6) AS flops, round(sum(flops) / 1e13 * 1e3, 6) AS est_ms FROM l GROUP BY ALL",
    "rf_layer_params": f"WITH {derived_sql('layers', 'l')} SELECT model, pos, CAST(inputs AS BIGINT) * outputs * coalesce(list_reduce(kernel, lambda a, b: a * b), 1) + outputs AS n_params FROM l",
    "vc_alignment": f"""WITH {derived_sql('shapes', 's')}, x AS (SELECT *, flatten(list_transform(list_filter(shapes, lambda s: len(s) >= 2), lambda s: s[len(s) - 1:len(s)])) AS ends, flatten(list_transform(list_filter(shapes, lambda s: len(s) = 4), lambda s: s[1:2])) AS starts FROM s),
      y AS (SELECT *, CASE WHEN gpu THEN list_reduce(list_concat([0.8::DOUBLE], list_transform(shapes, lambda s: CASE WHEN s[len(s)] % 8 <> 0 THEN 0.7 ELSE 1.0 END * CASE WHEN len(list_filter(s, lambda d: d % 32 = 0 AND d % 64 <> 0)) > 0 THEN 0.9 ELSE 1.0 END)), lambda a, b: a * b) ELSE 0.8 END
        * CASE WHEN regexp_matches(op, 'matmul|gemm|bmm|addmm') THEN list_reduce(list_concat([1.0::DOUBLE], list_transform(ends, lambda d: CASE WHEN d % 64 = 0 THEN 1.0 WHEN d % 32 = 0 THEN 0.95 WHEN d % 16 = 0 THEN 0.9 WHEN d % 8 = 0 THEN 0.85 ELSE 0.7 END)), lambda a, b: a * b) ELSE 1 END AS e, CASE WHEN contains(op, 'conv') THEN starts ELSE ends END AS dims FROM x)
      SELECT line, op, round(greatest(0.1, least(1, e)), 6) AS efficiency, regexp_matches(op, 'matmul|conv|linear|addmm|bmm|gemm') AND len(dims) > 0 AND len(list_filter(dims, lambda d: d % CASE WHEN capability >= 8 THEN 4 ELSE 8 END <> 0)) = 0 AS tensor_core FROM y""",
    "vc_flops_and_bytes": f"""WITH {derived_sql('shapes', 's')}, x AS (SELECT *, list_reduce(list_transform(shapes[1], lambda d: CAST(d AS DOUBLE)), lambda a, b: a * b) AS n FROM s)
      SELECT line, op, list_sum(list_transform(shapes, lambda s: CASE WHEN list_min(s) > 0 THEN 4.0 * list_reduce(list_transform(s, lambda d: CAST(d AS DOUBLE)), lambda a, b: a * b) ELSE 0 END)) AS bytes, CASE op WHEN 'linear' THEN 2 * n * out_features WHEN 'layer_norm' THEN 5 * n WHEN 'relu' THEN n WHEN 'gelu' THEN 8 * n END AS flops FROM x""",
    "tx_regex_rules": f"WITH {_CODE}, {_RULES} SELECT snippet_id, rule, severity, suggestion FROM c JOIN r ON regexp_matches(code, pattern) AND (unless IS NULL OR NOT regexp_matches(code, unless))",
    "tx_severe_rules": f"WITH {_CODE}, {_RULES} SELECT snippet_id, rule FROM c JOIN r ON regexp_matches(code, pattern) AND (unless IS NULL OR NOT regexp_matches(code, unless)) WHERE {_RANKED} >= 2 AND rule <> 'append_in_loop' QUALIFY row_number() OVER (PARTITION BY snippet_id ORDER BY {_RANKED} DESC, rule) = 1",
    "tx_architecture_vote": f"WITH {_CODE} {_vote('SELECT * FROM c')}",
    "tx_pattern_scan": f"WITH {_CODE}, {_v(textscan.PATTERNS, 'pattern string, family string, time string, space string', 'p')} SELECT snippet_id, pattern, family, time, space FROM c JOIN p ON contains(lower(code), pattern)",
    "tx_recognize": _RECOGNIZED,
    "tx_inferred": _INFERRED,
    "tx_aligned": f"WITH a(framework, algorithm) AS (VALUES {', '.join(f'''('{f}', '{n}')''' for f, names in textscan.ALIGNED.items() for n in names)}) SELECT snippet_id, algorithm, framework FROM ({_RECOGNIZED}) JOIN (SELECT snippet_id, name AS framework FROM ({_INFERRED}) WHERE kind = 'framework') USING (snippet_id) JOIN a USING (framework, algorithm)",
    "tx_settings": f"WITH {_CODE} SELECT snippet_id, try_cast(nullif(regexp_extract(code, 'batch_size\\s*=\\s*(\\d+)', 1), '') AS DOUBLE) AS batch_size, try_cast(nullif(regexp_extract(code, 'seq_len\\w*\\s*=\\s*(\\d+)', 1), '') AS DOUBLE) AS seq_len FROM c",
    "tx_keyword_overlap": f"WITH {derived_sql("words_a", "a")}, {derived_sql("words_b", "b")}, s AS (SELECT a.name AS a_name, b.name AS b_name, len(list_intersect(a.keywords, b.keywords)) / greatest(len(a.keywords), len(b.keywords)) AS score FROM a, b) SELECT a_name, b_name, round(score, 6) AS score FROM s WHERE score > 0.5",
    "tx_conversations": f"SELECT architecture, count(*) AS n, CAST(sum(votes) AS BIGINT) AS votes FROM ({_vote('''SELECT conv_id || '-' || turn AS snippet_id, coalesce(text, '') AS code FROM conversations''')}) GROUP BY 1",
}
_RANKING = ORACLES["co_instance_rank"]
ORACLES |= {
    "co_top_alternatives": f"SELECT name, rank, instance, cost FROM ({_RANKING}) WHERE rank <= 5",
    "co_comparison": f"WITH t AS (SELECT * FROM ({_RANKING}) WHERE rank <= 5), r AS (SELECT DISTINCT name, 0 AS place, current AS instance FROM t UNION ALL SELECT name, rank, instance FROM t), {_PRICES} SELECT name, CAST(place AS INTEGER) AS place, instance, round(cost, 6) AS cost, coalesce(gpus, 0) AS gpus, coalesce(ram, 0) AS memory FROM r JOIN p USING (instance)",
    "co_cost_breakdown": f"SELECT name, round(current_cost, 6) AS current, round(cost, 6) AS recommended, round(greatest(0, current_cost - cost), 6) AS savings FROM ({_RANKING}) WHERE rank = 1",
    "co_validated_results": f"WITH {derived_sql('results', 'r')} SELECT strategy, CASE WHEN throughput IS NULL OR memory_gb IS NULL THEN 'missing' WHEN throughput <= 0 THEN 'invalid' ELSE 'ok' END AS status FROM r",
    "rf_inference_time": f"WITH {derived_sql('layers', 'l')} SELECT model, round(sum(flops) * 1e9 / 1e10, 6) AS cpu_s, round(sum(flops) * 1e9 / 1e13, 6) AS gpu_s FROM l GROUP BY 1 HAVING sum(flops) > 0",
}

#: What the pieces of code in the scripts hold, by the number of the order.
_KIND = "o_orderkey % 6"
ORACLES |= {
    "cs_call_frequency": f"SELECT call, count(*) AS n FROM (SELECT unnest(CASE {_KIND} WHEN 0 THEN ['range', 'g' || o_custkey % 17] WHEN 1 THEN ['h', 'h'] WHEN 2 THEN ['dot'] ELSE [] END) AS call FROM orders) GROUP BY 1",
    "cs_code_facts": f"""SELECT 'o' || o_orderkey AS snippet_id, {_KIND} <> 3 AS parsed, CAST(CASE WHEN {_KIND} IN (0, 4) THEN 1 ELSE 0 END AS INTEGER) AS loop_depth, CAST(CASE {_KIND} WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS recursive_calls,
      CASE {_KIND} WHEN 0 THEN 'O(n)' WHEN 1 THEN 'O(2^n)' WHEN 3 THEN 'Unknown' WHEN 4 THEN 'O(log n)' ELSE 'O(1)' END AS complexity, CASE {_KIND} WHEN 2 THEN 'numpy,os' ELSE '' END AS imports, CASE {_KIND} WHEN 0 THEN 'f' || o_custkey % 3 WHEN 1 THEN 'h' WHEN 4 THEN 's' ELSE '' END AS functions,
      CASE {_KIND} WHEN 0 THEN 'range,g' || o_custkey % 17 WHEN 1 THEN 'h,h' WHEN 2 THEN 'dot' ELSE '' END AS calls, CASE {_KIND} WHEN 0 THEN 'f' || o_custkey % 3 || '>g' || o_custkey % 17 || ',f' || o_custkey % 3 || '>range' WHEN 1 THEN 'h>h' ELSE '' END AS edges, '' AS frames FROM orders""",
}
