"""Rules over code text, as regular expressions and substrings: findings are rows.

Nulls and edges: a null text matches nothing; empty code is unknown and runs on a CPU; repeated snippets give their findings once where findings are rows; empty tables give empty results; a snippet's id may be null.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.stages import dealt
from fieldglass.operators import ruleindex

#: Fixed values. Architectures, in order of precedence, and what speaks for them.
ARCHITECTURES = [
    ("transformer", [r"(attention|transformer|mha|multi.?head|bert|gpt|llm|roberta|t5|bart|electra|albert|distilbert|longformer|reformer|xlnet)", r"(encoder|decoder).+layers", r"self\.attention"]),
    ("cnn", [r"(conv[2-3]?d|convolution|kernel|maxpool|avgpool)", r"(stride|padding|channels|filters)"]),
    ("rnn", [r"(rnn|lstm|gru|recurrent)", r"hidden.?state", r"cell.?state"]),
    ("gan", [r"(gan|generative.?adversarial|generator|discriminator)", r"(real|fake).+(loss|images|data)"]),
    ("diffusion", [r"(diffusion|noise|denoise|unet|denoising)", r"(timestep|step|scheduler|sampling)", r"(reverse|forward).+process", r"(score|prediction).+based"]),
    ("autoencoder", [r"(autoencoder|encoder|decoder|latent|vae|embedding)", r"(reconstruct|bottleneck)"]),
    ("quantized", [r"(quantization|quantize|int8|fp16|bfloat16)", r"(qconfig|fake_quant|dynamic_range)", r"(observer|scale_factor|zero_point)"]),
    ("pruned", [r"(mask|threshold)", r"(structured|unstructured)", r"(weight_decay|regularization|l1|l0)"]),
]
#: Known algorithms by name: time and space.
PATTERNS = [
    ("linear_search", "general", "O(n)", "O(1)"),
    ("binary_search", "general", "O(log n)", "O(1)"),
    ("quicksort", "general", "O(n log n), O(n²)", "O(log n)"),
    ("mergesort", "general", "O(n log n)", "O(n)"),
    ("bubble_sort", "general", "O(n²)", "O(1)"),
    ("bfs", "general", "O(V+E)", "O(V)"),
    ("dfs", "general", "O(V+E)", "O(V)"),
    ("dijkstra", "general", "O(V² + E), O((V+E)log V)", "O(V)"),
    ("dynamic_programming", "general", "O(n²), O(n)", "O(n), O(n²)"),
    ("matrix_multiply", "general", "O(n³)", "O(n²)"),
    ("knn", "general", "O(n²)", "O(n)"),
    ("kmeans", "general", "O(n*k*i)", "O(n+k)"),
    ("linear_regression", "ml", "O(n*d²)", "O(d²)"),
    ("logistic_regression", "ml", "O(n*d*i)", "O(d)"),
    ("decision_tree", "ml", "O(n*d*log(n))", "O(n)"),
    ("random_forest", "ml", "O(t*n*d*log(n))", "O(t*n)"),
    ("svm", "ml", "O(n²*d)", "O(n)"),
    ("neural_network", "ml", "O(n*e*l*h²)", "O(l*h²)"),
    ("cnn", "ml", "O(n*e*c*f²*k²)", "O(c*f²)"),
    ("rnn", "ml", "O(n*e*s*h²)", "O(s*h²)"),
    ("transformer", "ml", "O(n*e*s²*h)", "O(s²*h)"),
    ("kmeans", "ml", "O(n*k*i*d)", "O(n+k)"),
    ("pca", "ml", "O(n*d²)", "O(d²)"),
]
ALGORITHMS = [
    ("Linear Regression", [r"LinearRegression", r"np\.linalg\.lst", r"gradient descent", r"normal equation"]),
    ("Transformer", [r"Transformer", r"attention", r"multi.?head", r"encoder", r"decoder"]),
    ("Vision Transformer", [r"ViT", r"vision.?transformer", r"patch.?embed"]),
    ("Graph Neural Network", [r"GNN", r"GraphConv", r"MessagePassing", r"graph.?neural", r"node_features"]),
    ("Diffusion Model", [r"diffusion", r"DDPM", r"DDIM", r"score.?based", r"noise.?prediction"]),
    ("Reinforcement Learning", [r"PPO", r"DQN", r"A2C", r"DDPG", r"reinforcement", r"reward", r"action.*space"]),
]
#: Frameworks and compression techniques, each with the patterns of which any speaks for it.
FRAMEWORK_PATTERNS = [
    ("PyTorch", [r"import torch", r"nn\.Module", r"torch\."]),
    ("TensorFlow", [r"import tensorflow", r"import tf", r"tf\."]),
    ("JAX", [r"import jax", r"jnp\.", r"jax\."]),
    ("ONNX", [r"import onnx", r"onnxruntime"]),
]
COMPRESSION_PATTERNS = [
    ("Quantization", [r"quantize", r"quantization", r"int8", r"QAT", r"post_training_quantization"]),
    ("Pruning", [r"prune", r"sparsity", r"sparse\."]),
    ("Knowledge Distillation", [r"distill", r"teacher.*student", r"knowledge.*transfer"]),
    ("Low-Rank Factorization", [r"svd", r"factorization", r"decomposition"]),
]
FRAMEWORKS, COMPRESSION = ([(name, "|".join(patterns)) for name, patterns in table] for table in (FRAMEWORK_PATTERNS, COMPRESSION_PATTERNS))
HARDWARE = [("GPU", r"cuda|gpu|device|to\(['\"]cuda"), ("TPU", r"tpu|xla|pjit"), ("Edge", r"quantize|tflite|coreml|onnx|mobile|edge")]
CLOUDS = [("AWS", r"aws|amazon|ec2|s3|sagemaker"), ("GCP", r"gcp|google cloud|gcs|vertex|gke"), ("Azure", r"azure|microsoft|blob")]
ALIGNED = {"PyTorch": ["Transformer", "Vision Transformer", "Graph Neural Network", "Diffusion Model"], "TensorFlow": ["Transformer", "Vision Transformer", "Diffusion Model"], "JAX": ["Transformer", "Diffusion Model"]}
RULES_SCHEMA = "rule string, pattern string, unless string, severity string, suggestion string"
RULES = [
    ("pandas_iterrows", r"\.iterrows\(\)", None, "high", "use vectorized operations"),
    ("append_in_loop", r"for [^\n]*:\s*\n(\s+.*\n)*?\s+\w+\.append\(", None, "medium", "preallocate or use a comprehension"),
    ("cpu_gpu_transfer", r"\.cpu\(\)[^\n]*\.numpy\(\)", None, "medium", "keep data on the device"),
    ("loader_workers", r"DataLoader\(", r"num_workers\s*=\s*[1-9]", "medium", "set num_workers"),
    ("item_in_loop", r"for.*:.*\.item\(\)", None, "high", "collect results and synchronize once"),
    ("loop_over_loader", r"for.*in.*dataloader", None, "low", "use a data-parallel wrapper"),
    ("session", r"Session\(", None, "low", "use compiled functions"),
]
SEVERITY_RANK = ("low", "medium", "high", "critical")


def apply_rules(code: DataFrame, rules: DataFrame, min_severity: str = "low", disabled: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """snippet_id, rule, severity, suggestion: rules that match and whose exception does not; severities compare by rank."""
    rank = F.array_position(F.array(*[F.lit(x) for x in SEVERITY_RANK]), F.col("severity"))
    on = rules.filter((rank >= SEVERITY_RANK.index(min_severity) + 1) & ~F.col("rule").isin(list(disabled)))
    found = ruleindex.match_rules(code, on, "snippet_id", "code").join(on.drop("pattern", "unless"), "rule").select("snippet_id", "rule", "severity", "suggestion")
    if most is None:
        return found
    order = Window.partitionBy("snippet_id").orderBy(F.desc(F.array_position(F.array(*[F.lit(x) for x in SEVERITY_RANK]), F.col("severity"))), "rule")
    return found.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")


def architecture_vote(code: DataFrame) -> DataFrame:
    """snippet_id, architecture, votes: the architecture with the most pattern matches, ties to the first; unknown without any."""
    count = lambda ps: sum((F.regexp_count("code", F.lit(f"(?i){p}")) for p in ps), F.lit(0))
    votes = F.array(*[F.struct((-count(ps)).alias("v"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, ps) in enumerate(ARCHITECTURES)])
    best = code.select("snippet_id", F.array_min(votes).alias("b"))
    return best.select("snippet_id", F.when(F.col("b.v") < 0, F.col("b.name")).otherwise("unknown").alias("architecture"), (-F.col("b.v")).cast("long").alias("votes"))


def known_patterns(code: DataFrame) -> DataFrame:
    """snippet_id, pattern, family, time, space: known algorithms whose name stands in the code."""
    table = F.broadcast(code.sparkSession.createDataFrame(PATTERNS, "pattern string, family string, time string, space string"))
    rules = table.select(F.col("pattern").alias("rule"), F.concat(F.lit("(?i)"), "pattern").alias("pattern"), F.lit(None).cast("string").alias("unless"))
    found = ruleindex.match_rules(code, rules, "snippet_id", "code").withColumnRenamed("rule", "pattern")
    return found.join(table, "pattern").select("snippet_id", "pattern", "family", "time", "space")


def recognize(code: DataFrame) -> DataFrame:
    """snippet_id, algorithm, n_matched, confidence: 40 plus 10 per pattern matched, 80 at most."""
    hits = F.array(*[F.struct(F.lit(name).alias("algorithm"), sum((F.col("code").rlike(f"(?i){p}").cast("int") for p in ps), F.lit(0)).alias("n_matched")) for name, ps in ALGORITHMS])
    return code.select("snippet_id", F.inline(hits)).filter("n_matched > 0").withColumn("confidence", F.least(F.lit(80), 40 + 10 * F.col("n_matched")))


def shows(pattern: str) -> Column:
    """Whether ``code`` matches in any letter case. ``low`` is the code in lower case: a text without a literal of the pattern is not tried."""
    literals = ruleindex.required_literals(pattern)
    found = F.col("code").rlike(f"(?i){pattern}")
    return functools.reduce(lambda a, b: a | b, [F.contains("low", F.lit(x.lower())) for x in literals]) & found if all(literals) else found


def seen(code: DataFrame) -> DataFrame:
    """snippet_id, code, low and, from one pass, the arrays ``framework``, ``hardware`` (CPU where no other shows), ``cloud`` (the first only) and ``compression`` of (kind, name)."""
    rows = lambda kind, table: F.array_compact(F.array(*[F.when(shows(p), F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("name"))) for n, p in table]))
    low = dealt(code.select("snippet_id", "code")).withColumn("low", F.lower("code"))
    arrays = low.select("*", rows("framework", FRAMEWORKS).alias("framework"), rows("hardware", HARDWARE).alias("hardware"), F.slice(rows("cloud", CLOUDS), 1, 1).alias("cloud"), rows("compression", COMPRESSION).alias("compression"))
    return arrays.withColumn("hardware", F.when(F.size("hardware") == 0, F.array(F.struct(F.lit("hardware").alias("kind"), F.lit("CPU").alias("name")))).otherwise(F.col("hardware")))


def inferred(code: DataFrame) -> DataFrame:
    """snippet_id, kind (framework, hardware, cloud, compression), name; CPU where no other hardware shows, the first cloud only."""
    return seen(code).select("snippet_id", F.inline(F.concat("framework", "hardware", "cloud", "compression")))


def aligned(code: DataFrame) -> DataFrame:
    """snippet_id, algorithm, framework: recognized algorithms that are at home in a framework the snippet uses."""
    pairs = F.broadcast(code.sparkSession.createDataFrame([(f, a) for f, names in ALIGNED.items() for a in names], "framework string, algorithm string"))
    uses = inferred(code).filter("kind = 'framework'").select("snippet_id", F.col("name").alias("framework"))
    return recognize(code).select("snippet_id", "algorithm").join(uses, "snippet_id").join(pairs, ["framework", "algorithm"]).select("snippet_id", "algorithm", "framework")


def settings(code: DataFrame) -> DataFrame:
    """snippet_id, batch_size, seq_len as written in the code; NULL where absent."""
    number = lambda p: F.expr(f"try_cast(nullif(regexp_extract(code, '{p}', 1), '') as double)")
    return code.select("snippet_id", number(r"batch_size\\s*=\\s*(\\d+)").alias("batch_size"), number(r"seq_len\\w*\\s*=\\s*(\\d+)").alias("seq_len"))


def keyword_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_name, b_name, score: shared keywords over the larger set, where over one half; both tables are short lists of (name, keywords)."""
    pairs = a.select(F.col("name").alias("a_name"), F.col("keywords").alias("ka"), F.explode_outer("keywords").alias("w")).join(b.select(F.col("name").alias("b_name"), F.col("keywords").alias("kb"), F.explode("keywords").alias("w")), "w")
    score = F.size(F.array_intersect("ka", "kb")) / F.greatest(F.size("ka"), F.size("kb"))
    return pairs.select("a_name", "b_name", score.alias("score")).distinct().filter("score > 0.5")
