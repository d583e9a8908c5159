"""Advice: findings met with tables of recommendations, rules over measured facts, and small formatting helpers.

Nulls: a rule whose measure is NULL does not fire; rows without any advice give no row; an empty table gives an empty
result. Snippet, model and rule names are unique; other repeated rows give repeated advice. The recommendation tables are fixed lists, joined on equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.operators import textscan

# Lookup tables of recommendations.
PATTERN_ADVICE_SCHEMA = "pattern string, recommendation string, historical_impact string"
PATTERN_ADVICE = [
    ("nested_loop_with_numpy", "Replace nested loops with vectorized operations using numpy.einsum or matrix operations", "Typical speedup: 10-100x"),
    ("pytorch_lstm_loop", "Use packed sequences and torch.nn.utils.rnn.pack_padded_sequence for variable length sequences", "Memory reduction: 30-60%, Speed improvement: 2-5x"),
    ("repeated_tensor_allocation", "Pre-allocate tensors outside loop and reuse", "Reduces memory fragmentation and improves speed by 5-20%"),
    ("transformer_sequential_attention", "Use torch.nn.MultiheadAttention with batch_first=True option", "Speed improvement: 2-3x on large batches"),
]
ISSUES_SCHEMA = "framework string, pattern string, suggestion string"
ISSUES = [
    ("PyTorch", r"for.*in.*dataloader", "Use DataParallel or DistributedDataParallel"),
    ("PyTorch", r"\.cuda\(\)", "Use device-agnostic code with .to(device)"),
    ("PyTorch", r"\.item\(\).*for loop", "Avoid .item() in training loops, batch operations"),
    ("TensorFlow", r"Session\(", "Use tf.function for TF2.x performance"),
    ("TensorFlow", r"for.*in.*dataset", "Ensure dataset is properly prefetched/cached"),
    ("TensorFlow", r"placeholder", "Use TF2.x eager execution with tf.function"),
    ("JAX", r"for.*in.*range", "Use jax.vmap for vectorization"),
    ("JAX", r"jnp\..*inside loop", "Move computations outside loops with jax.vmap or lax.scan"),
]
TOOLS_SCHEMA = "technique string, framework string, implementation string"
TOOLS = [
    ("Quantization", "PyTorch", "torch.quantization"),
    ("Quantization", "PyTorch", "torch.ao.quantization"),
    ("Quantization", "TensorFlow", "tf.quantization"),
    ("Quantization", "TensorFlow", "TFLiteConverter.optimizations"),
    ("Quantization", "ONNX", "onnxruntime.quantization"),
    ("Pruning", "PyTorch", "torch.nn.utils.prune"),
    ("Pruning", "PyTorch", "torch.nn.utils.sparse"),
    ("Pruning", "TensorFlow", "tensorflow_model_optimization.sparsity"),
    ("Pruning", "Keras", "keras_pruning"),
    ("Knowledge Distillation", "PyTorch", "torch.nn.KLDivLoss"),
    ("Knowledge Distillation", "TensorFlow", "tf.keras.losses.KLDivergence"),
    ("Knowledge Distillation", "Hugging Face", "transformers.DistillationTrainer"),
    ("Low-Rank Factorization", "PyTorch", "torch.svd"),
    ("Low-Rank Factorization", "TensorFlow", "tf.linalg.svd"),
    ("Low-Rank Factorization", "NumPy", "np.linalg.svd"),
]
PLATFORM_SCHEMA = "kind string, name string, recommendation string"
PLATFORM = [
    ("hardware", "CPU", "Use MKL-optimized libraries"),
    ("hardware", "CPU", "Consider ONNX Runtime for inference"),
    ("hardware", "CPU", "Enable multi-threading for data loading"),
    ("hardware", "GPU", "Use mixed precision training (FP16)"),
    ("hardware", "GPU", "Optimize memory transfers between CPU and GPU"),
    ("hardware", "GPU", "Adjust batch size to maximize GPU utilization"),
    ("hardware", "TPU", "Use TPU-specific optimizers and layers"),
    ("hardware", "TPU", "Ensure model is compatible with XLA compilation"),
    ("hardware", "TPU", "Use bfloat16 precision"),
    ("hardware", "Edge", "Quantize model to INT8"),
    ("hardware", "Edge", "Prune model to reduce size"),
    ("hardware", "Edge", "Use model distillation for smaller footprint"),
    ("cloud", "AWS", "Use spot instances for training"),
    ("cloud", "AWS", "Consider Savings Plans for consistent workloads"),
    ("cloud", "AWS", "Enable auto-scaling for inference endpoints"),
    ("cloud", "GCP", "Use preemptible VMs for training"),
    ("cloud", "GCP", "Consider committed use discounts"),
    ("cloud", "GCP", "Use Vertex AI for managed training"),
    ("cloud", "Azure", "Use spot instances for training"),
    ("cloud", "Azure", "Consider reserved instances for consistent workloads"),
    ("cloud", "Azure", "Enable autoscaling for inference endpoints"),
    ("cloud", "general", "Consider spot/preemptible instances for training"),
    ("cloud", "general", "Set up auto-scaling for inference endpoints"),
    ("cloud", "general", "Monitor and terminate unused resources"),
    ("cloud", "general", "Use managed ML services for automatic resource optimization"),
]
TECHNIQUES_SCHEMA = "technique string, recommendation string"
TECHNIQUES = [
    ("Quantization", "Apply post-training quantization for inference speedup"),
    ("Quantization", "Use quantization-aware training for better accuracy preservation"),
    ("Quantization", "Consider dynamic quantization for RNNs and transformers"),
    ("Pruning", "Start with gradual pruning for minimal accuracy loss"),
    ("Pruning", "Consider structured pruning for hardware acceleration compatibility"),
    ("Pruning", "Apply magnitude pruning to remove the smallest weights"),
    ("Knowledge Distillation", "Use a larger teacher model with your smaller student model"),
    ("Knowledge Distillation", "Match intermediate representations for deeper knowledge transfer"),
    ("Knowledge Distillation", "Combine hard and soft targets for better performance"),
    ("Low-Rank Factorization", "Apply to fully connected layers with many parameters"),
    ("Low-Rank Factorization", "Consider Tucker decomposition for convolutional layers"),
    ("Low-Rank Factorization", "Use SVD to find optimal low-rank approximation"),
]
INSTANCES_SCHEMA = "name string, class string, instances array<string>"
INSTANCES = [
    ("AWS", "compute_optimized", ["c5", "c6g", "c7g"]),
    ("AWS", "memory_optimized", ["r5", "r6g", "x2gd"]),
    ("AWS", "accelerated_computing", ["p3", "p4d", "g4dn"]),
    ("GCP", "compute_optimized", ["c2", "c2d"]),
    ("GCP", "memory_optimized", ["m1", "m2"]),
    ("GCP", "accelerated_computing", ["a2", "g2"]),
    ("Azure", "compute_optimized", ["F-series", "Fsv2-series"]),
    ("Azure", "memory_optimized", ["E-series", "Esv4-series"]),
    ("Azure", "accelerated_computing", ["NC-series", "ND-series"]),
]
BATCHES = (1, 2, 4, 8, 16, 32, 64, 128)


def _fixed(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A table of fixed values, some dozens of rows: Spark knows no size for it, and would deal all that it meets by its few keys."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def _fires(*rules: tuple[Column, str, str, str]) -> Column:
    """The rules that fire, as an array of (type, severity, advice)."""
    parts = [F.when(on, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(advice).alias("advice"))) for on, kind, severity, advice in rules]
    return F.array_compact(F.array(*parts))


def pattern_advice(found: DataFrame) -> DataFrame:
    """Findings (with a column ``pattern``) with their recommendation and known impact; unknown patterns give no row."""
    return found.join(_fixed(found, PATTERN_ADVICE, PATTERN_ADVICE_SCHEMA), "pattern")


def _in_line(pattern: str) -> str:
    """``a.*b.*c`` of literals, without trying every place of ``b`` for each ``a``: what comes first leaves most room for the rest."""
    first, *rest = pattern.split(".*")
    return first + "".join(f"(?>.*?{x})" for x in rest)


def framework_issues(code: DataFrame) -> DataFrame:
    """snippet_id, framework, pattern, suggestion: habits that cost time in a framework the snippet uses, in any letter case. A row without a name gives none."""
    uses = lambda name: F.exists("framework", lambda x: x["name"] == name)
    tried = lambda p: F.contains("low", F.lit(textscan.ruleindex.required_literals(p)[0].lower())) & F.col("code").rlike(f"(?i){_in_line(p)}")
    issues = [F.when(uses(f) & tried(p), F.struct(F.lit(f).alias("framework"), F.lit(p).alias("pattern"), F.lit(s).alias("suggestion"))) for f, p, s in ISSUES]
    return textscan.seen(code).filter("snippet_id is not null").select("snippet_id", F.inline(F.array_compact(F.array(*issues))))


def compression_openings(code: DataFrame) -> DataFrame:
    """snippet_id, technique, framework, implementation: techniques that a snippet does not use yet and its frameworks offer; without a framework, every technique for ``any``."""
    seen = textscan.inferred(code)
    uses = seen.filter("kind = 'framework'").select("snippet_id", F.col("name").alias("framework"))
    done = seen.filter("kind = 'compression'").select("snippet_id", F.col("name").alias("technique"))
    offered = uses.join(_fixed(code, TOOLS, TOOLS_SCHEMA), "framework").select("snippet_id", "technique", "framework", "implementation")
    every = F.array(*[F.lit(name) for name, _ in textscan.COMPRESSION])
    general = code.select("snippet_id").join(uses, "snippet_id", "left_anti").select("snippet_id", F.explode(every).alias("technique"), F.lit("any").alias("framework"), F.lit(None).cast("string").alias("implementation"))
    return offered.unionByName(general).join(done, ["snippet_id", "technique"], "left_anti")


def platform_advice(code: DataFrame) -> DataFrame:
    """snippet_id, kind (hardware, cloud), name, recommendation; general advice where no cloud shows."""
    general = F.array(F.struct(F.lit("cloud").alias("kind"), F.lit("general").alias("name")))
    found = textscan.seen(code).select("snippet_id", F.inline(F.concat("hardware", F.when(F.size("cloud") == 0, general).otherwise(F.col("cloud")))))
    return found.join(_fixed(code, PLATFORM, PLATFORM_SCHEMA), ["kind", "name"]).select("snippet_id", "kind", "name", "recommendation")


def technique_advice(code: DataFrame) -> DataFrame:
    """snippet_id, technique, recommendation for every technique that a snippet does not use yet and its frameworks offer."""
    open_ = compression_openings(code).select("snippet_id", "technique").distinct()
    return open_.join(_fixed(code, TECHNIQUES, TECHNIQUES_SCHEMA), "technique").select("snippet_id", "technique", "recommendation")


def instance_advice(code: DataFrame) -> DataFrame:
    """snippet_id, name (of the cloud that shows), class, instance: instance types worth a look; no row without a cloud."""
    clouds = textscan.inferred(code).filter("kind = 'cloud'").select("snippet_id", "name")
    return clouds.join(_fixed(code, INSTANCES, INSTANCES_SCHEMA), "name").select("snippet_id", "name", "class", F.explode("instances").alias("instance"))


def robustness_advice(scores: DataFrame, attacks: DataFrame, details: DataFrame) -> DataFrame:
    """model, type, severity, advice from a model's score, its results by attack and their summary (tables of :mod:`fieldglass.operators.security`)."""
    s = F.col("score")
    general = _fires(
        (F.lit(True), "training", "info", "train on adversarial examples"), (F.lit(True), "ensemble", "info", "combine several models"),
        (s < 30, "architecture", "high", "redesign for robustness"), (s < 30, "training", "high", "defensive distillation"), (s < 30, "input", "high", "preprocess inputs"),
        ((s >= 30) & (s < 60), "training", "medium", "regularize"), ((s >= 30) & (s < 60), "input", "medium", "squeeze features"), ((s >= 30) & (s < 60), "training", "medium", "mask gradients"),
    )
    low = lambda kind, below: (F.col("attack") == kind) & (F.col("robustness") < below)
    by_attack = _fires(
        (low("fgsm", 0.5), "attack", "medium", "mask gradients against gradient attacks"), (low("pgd", 0.4), "attack", "medium", "train on projected gradient attacks"),
        (low("carlini_wagner", 0.3), "attack", "medium", "distil against optimization attacks"), (low("spatial_transformation", 0.6), "attack", "medium", "train on spatial transformations"),
    )
    summary = _fires(
        (F.col("worst_case") < 0.2, "worst case", "high", "train on the weakest attack"), (F.col("consistency") < 0.5, "consistency", "medium", "even out attacks"), (F.col("avg_success") > 0.7, "detection", "high", "detect adversarial examples"),
    )
    return scores.select("model", F.inline(general)).unionByName(attacks.select("model", F.inline(by_attack)).distinct()).unionByName(details.select("model", F.inline(summary)))


def complexity_advice(runs: DataFrame) -> DataFrame:
    """name, type, severity, advice from big_o, architecture, memory_mb (of the largest input), slowest_s and source."""
    o, src, memory, diffusion = F.col("big_o"), F.col("source"), F.col("memory_mb"), F.col("architecture") == "diffusion"
    rules = _fires(
        (F.col("architecture") != "unknown", "architecture", "info", "architecture detected"),
        (diffusion, "optimization", "medium", "distil sampling steps, low-rank adapters, half precision"),
        (diffusion & (memory > 50), "memory", "high", "smaller batches, checkpoint gradients"),
        (o.contains("n^2") | o.contains("n^3"), "complexity", "high", "find an algorithm of lower order"),
        (o.contains("2^n"), "complexity", "critical", "avoid exponential recursion"),
        (memory > 100, "memory", "medium", "process in smaller chunks"),
        (F.col("slowest_s") > 0.1, "hotspot", "medium", "optimize the slowest call"),
        (o.contains("2^n") & src.contains("return"), "optimization", "high", "memoize"),
        (o.contains("n^") & src.contains("for"), "optimization", "medium", "parallelize or vectorize the loops"),
    )
    return runs.select("name", F.inline(rules))


def model_advice(models: DataFrame) -> DataFrame:
    """model, type, severity, advice from params, architecture, heads, layer_kinds, memory_mb and framework; missing layers count as none."""
    arch, framework = F.col("architecture"), F.col("framework")
    has_norm = F.exists(F.coalesce("layer_kinds", F.array().cast("array<string>")), lambda k: F.coalesce(k.contains("BatchNorm"), F.lit(False)))
    rules = _fires(
        (F.col("params") > 10_000_000, "optimization", "high", "quantize"),
        (arch == "Transformer", "performance", "medium", "use an inference runtime"),
        ((arch == "Transformer") & (F.col("heads") > 8), "architecture", "medium", "prune attention heads"),
        ((arch == "CNN") & ~has_norm, "architecture", "medium", "add batch normalization"),
        (F.col("memory_mb") > 1024, "memory", "high", "checkpoint gradients, mixed precision or sharding"),
        (framework == "pytorch", "deployment", "low", "export a compiled script"),
        (framework == "tensorflow", "deployment", "low", "export to a tensor runtime"),
    )
    return models.select("model", F.inline(rules))


def loop_advice(loops: DataFrame, imports: DataFrame) -> DataFrame:
    """snippet_id, line, type, severity, advice from naive loops (snippet_id, line, depth, vectorizable, reason) and imports (snippet_id, module).

    The reason decides the kind, first hit wins: arithmetic, comprehension, iterating over arrays or frames. Once a
    snippet: import numpy where it is missing, at its first loop; the nested loops, at the first of them.
    """
    reason = F.lower(F.coalesce("reason", F.lit("")))
    kind = F.when(reason.contains("arithmetic"), 1).when(reason.contains("comprehension"), 2).when(reason.contains("iterating over numpy") | reason.contains("pandas"), 3)
    can = F.col("vectorizable") & kind.isNotNull()
    each = loops.select("snippet_id", "line", F.inline(_fires((can & (kind == 1), "vectorization", "medium", "vectorize arithmetic"), (can & (kind == 2), "vectorization", "low", "replace the comprehension"), (can & (kind == 3), "vectorization", "high", "do not iterate over arrays or frames"))))
    nested = loops.filter("depth > 1").groupBy("snippet_id").agg(F.min("line").alias("line")).select("snippet_id", "line", F.lit("vectorization").alias("type"), F.lit("high").alias("severity"), F.lit("vectorize nested loops").alias("advice"))
    lacking = loops.groupBy("snippet_id").agg(F.min("line").alias("line")).join(imports.filter("module = 'numpy'"), "snippet_id", "left_anti")
    missing = lacking.select("snippet_id", "line", F.lit("import").alias("type"), F.lit("medium").alias("severity"), F.lit("import numpy").alias("advice"))
    return each.unionByName(nested).unionByName(missing)


def rule_suggestions(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """snippet_id, title, severity, confidence, source, reason: suggestions of matched rules; profiler evidence (rule, time_impact, memory_impact; one row a rule) is added to the reason."""
    time = F.format_string("Profiling evidence: %.1fx slower execution", "time_impact")
    memory = F.format_string("Memory impact: %.1fx higher memory usage", "memory_impact")
    reason = F.concat_ws("\n", F.concat(F.lit("Rule-based detection: "), "rule"), F.when(F.col("time_impact").isNotNull(), time), F.when(F.col("memory_impact").isNotNull(), memory))
    source = F.when(F.col("time_impact").isNotNull() | F.col("memory_impact").isNotNull(), "profiler").otherwise("rule")
    joined = findings.select("snippet_id", "rule", "severity").join(evidence.select("rule", "time_impact", "memory_impact"), "rule", "left")
    return joined.select("snippet_id", F.initcap(F.translate("rule", "_", " ")).alias("title"), "severity", F.lit(1.0).alias("confidence"), source.alias("source"), reason.alias("reason"))


def tensor_core_share(ops: DataFrame, by: str) -> DataFrame:
    """``by``, share: operations that use tensor cores over those that could (columns eligible, used); 0 where none could."""
    able = F.count_if("eligible")
    return ops.groupBy(by).agg(F.coalesce(F.try_divide(F.count_if(F.col("eligible") & F.col("used")), able), F.lit(0.0)).alias("share"))


def top_bound_ops(ops: DataFrame, most: int = 5) -> DataFrame:
    """model, bound, pos, op: the first operations, in order of ``pos``, of the kind of bound (memory, compute) that a model has more of; compute on a tie."""
    votes = ops.groupBy("model").agg(F.when(F.count_if(F.col("bound") == "memory") > F.count_if(F.col("bound") == "compute"), "memory").otherwise("compute").alias("bound"))
    order = Window.partitionBy("model").orderBy("pos", "op")
    return ops.join(votes, ["model", "bound"]).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).select("model", "bound", "pos", "op")


def human_bytes(size: Column) -> Column:
    """``size`` in B, KB, MB, GB or TB by steps of 1024, two places, halves to even; NULL stays NULL."""
    out, form = None, lambda step, unit: F.concat(F.format_string("%.2f", F.bround(size.cast("double") / float(1024**step), 2)), F.lit(f" {unit}"))
    for step, unit in enumerate(("B", "KB", "MB", "GB")):
        on = size < 1024 ** (step + 1)
        out = F.when(on, form(step, unit)) if out is None else out.when(on, form(step, unit))
    return out.when(size.isNotNull(), form(4, "TB"))


def memory_sweep(models: DataFrame, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """model, batch, bytes, human: memory over batch sizes by a line; 20 % of the measured bytes are fixed (50 % at batch 1 or unknown)."""
    fixed = F.col("bytes") * F.when(F.col("batch") > 1, 0.2).otherwise(0.5)
    each = (F.col("bytes") - fixed) / F.greatest(F.coalesce("batch", F.lit(1)), F.lit(1))
    rows = models.filter("bytes is not null").select("model", fixed.alias("f"), each.alias("e"), F.explode(F.array(*map(F.lit, batches))).alias("to"))
    return rows.select("model", F.col("to").alias("batch"), (F.col("f") + F.col("to") * F.col("e")).alias("bytes")).withColumn("human", human_bytes(F.col("bytes")))


def version_stamp(at: Column) -> Column:
    """A version name from a time, as yyyyMMdd_HHmmss."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def fingerprints(layers: DataFrame) -> DataFrame:
    """model, fingerprint: md5 over kind and params of a model's layers in order of ``pos``; NULL fields count as empty.

    One model's layers are gathered into one row: a model has at most some thousands.
    """
    parts = F.struct(F.col("pos").alias("p"), F.concat_ws(":", F.coalesce("kind", F.lit("")), F.coalesce(F.col("params").cast("string"), F.lit(""))).alias("t"))
    return layers.groupBy("model").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["t"]), ",")).alias("fingerprint"))
