"""Facts about models, machines, operations, code and runs, derived from the given tables: the inputs of queries on rules, costs and scores.

Each is one SELECT that Spark and DuckDB both understand. Tables are named in braces, lists are written ``@[...]``. Factors like
``1.2345678912345`` keep averages away from midpoints between two roundings.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fieldglass.plans.quality import read

#: Devices by part.
_DEVICE = "concat(CASE p_partkey % 5 WHEN 0 THEN 'Tesla V100-SXM2' WHEN 1 THEN 'NVIDIA A100-80GB PCIe' WHEN 2 THEN 'NVIDIA RTX 4060' WHEN 3 THEN 'Tesla T4' ELSE 'Unheard Of' END, ' no ', p_size)"
_PROVIDER = "CASE {0} % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' ELSE 'azure' END"
#: Pieces of code that pages are given, by their number.
_PIECES = [
    "import pandas as pd', chr(10), 'for i, row in df.iterrows():', chr(10), '    total += row.a", "import torch', chr(10), 'for x in loader: total += model(x).item()', chr(10), 'loader = DataLoader(ds, batch_size=', page_id % 90, ')",
    "import torch', chr(10), 'loader = DataLoader(ds, batch_size = 64, num_workers=4)', chr(10), 'seq_len=', page_id, '", "import torch.nn as nn', chr(10), 'class Encoder(nn.Module): self.attention = nn.MultiheadAttention(64, 8)",
    "import tensorflow as tf', chr(10), 'model = Conv2D(32, kernel_size=3, stride=1, padding=1)', chr(10), 'with tf.Session() as s: tf.placeholder()", "def binary_search(a, x): return kmeans(a)  # aws sagemaker, gradient descent", "import jax', chr(10), 'for i in range(3): jnp.ones(i)  # patch embed of a vision transformer, quantize, distill",
]

FACTS = {
    "prices": f"SELECT {_PROVIDER.format('p_partkey')} AS provider, concat('part-', p_partkey) AS instance, p_retailprice AS cost, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size % 8 + 1 AS INT) END AS gpus, CASE p_partkey % 6 WHEN 0 THEN 'A100' WHEN 1 THEN 'V100' WHEN 2 THEN 'A10G' WHEN 3 THEN 'T4' WHEN 4 THEN 'K80' END AS gpu_type, CAST(NULL AS INT) AS inferentia_chips, CAST(p_size * 8 AS INT) AS ram FROM {{part}}",
    "fleet": f"SELECT concat('machine-', c_nationkey) AS name, {_PROVIDER.format('c_nationkey')} AS provider, concat('part-', c_nationkey) AS instance, CASE WHEN c_nationkey = 7 THEN NULL ELSE avg(CASE WHEN c_custkey % 25 <= c_nationkey + 1 THEN 1.0 ELSE 0.0 END) END AS gpu_util, avg(CASE WHEN c_custkey % 25 > c_nationkey THEN 1.0 ELSE 0.0 END) AS memory_util FROM {{customer}} GROUP BY c_nationkey",
    "gated": " UNION ALL ".join(f"SELECT concat('s', l_suppkey) AS model, '{m}' AS metric, CAST({x} AS DOUBLE) AS value FROM {{lineitem}} GROUP BY l_suppkey" for m, x in (("size_mb", "max(l_extendedprice) / 1000"), ("latency_ms", "count(*) % 100"), ("reduction", "(count(*) % 60) / 100.0"), ("security", "60 + count(*) % 30"), ("robustness", "30 + count(*) % 20"))),
    "loads": "SELECT concat('c', o_custkey) AS name, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE max(o_totalprice) / 1234567.8912345 END AS latency_s, CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE CAST(count(*) * 123456789 AS BIGINT) END AS peak_bytes, CAST(count(*) * 123457 AS BIGINT) AS requests FROM {orders} GROUP BY o_custkey",
    "devices": f"SELECT DISTINCT {_DEVICE} AS device FROM {{part}}",
    "ops": f"SELECT concat('s', l_suppkey) AS model, {_DEVICE} AS device, concat(l_orderkey, '-', l_linenumber) AS op, l_extendedprice * 0.000012345678912345 AS flops, CASE WHEN l_tax = 0 THEN CAST(0 AS DOUBLE) ELSE l_quantity * 0.0002345678912345 END AS bytes, l_quantity * 0.51234567891 AS time_us FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey",
    "layers": "SELECT concat('o', l_orderkey) AS model, l_linenumber AS pos, CASE WHEN l_returnflag = 'R' THEN 'conv' ELSE 'linear' END AS kind, CAST(l_partkey * 9 AS BIGINT) AS params, CAST(floor(l_extendedprice) AS DOUBLE) AS flops, CAST(l_quantity AS INT) AS inputs, CAST(l_suppkey % 64 + 1 AS INT) AS outputs, CASE WHEN l_returnflag = 'R' THEN @[3, CAST(l_linenumber AS INT)] END AS kernel FROM {lineitem}",
    "shapes": "SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS line, CASE l_linenumber WHEN 1 THEN 'aten::matmul' WHEN 2 THEN 'cuda_addmm' WHEN 3 THEN 'conv2d' WHEN 4 THEN 'linear' WHEN 5 THEN 'relu' WHEN 6 THEN 'layer_norm' ELSE 'gelu' END AS op, CASE WHEN l_linenumber = 3 THEN @[@[8, CAST(l_suppkey % 33 AS INT), CAST(l_quantity AS INT), 32]] WHEN l_linenumber = 5 THEN @[@[CAST(l_partkey % 65 AS INT)]] ELSE @[@[CAST(l_quantity AS INT), CAST(l_suppkey % 130 AS INT)], @[CAST(l_suppkey % 130 AS INT), CAST(l_partkey % 65 AS INT) * 8]] END AS shapes, l_returnflag = 'R' AS gpu, CAST(7 + l_orderkey % 2 AS INT) AS capability, CASE WHEN l_tax > 0.05 THEN NULL ELSE CAST(l_partkey % 97 AS INT) END AS out_features FROM {lineitem}",
    "sizes": "SELECT concat('part-', p_partkey) AS model, p_retailprice * CASE p_size % 3 WHEN 0 THEN 1e5 WHEN 1 THEN 1e6 ELSE 1e7 END AS parameters, CAST(p_retailprice / 100 AS DOUBLE) AS size_gb, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(16 AS DOUBLE) WHEN 2 THEN CAST(24 AS DOUBLE) ELSE CAST(80 AS DOUBLE) END AS device_gb FROM {part}",
    "results": "SELECT concat(l_returnflag, l_linestatus, l_suppkey % 10) AS strategy, CASE WHEN l_suppkey % 10 = 4 THEN CAST(0 AS DOUBLE) ELSE CAST(count(*) AS DOUBLE) END AS throughput, CASE WHEN l_suppkey % 10 = 3 THEN NULL ELSE CAST(count(DISTINCT l_partkey) AS DOUBLE) END AS memory_gb FROM {lineitem} GROUP BY l_returnflag, l_linestatus, l_suppkey % 10",
    "sweep": "SELECT concat('c', o_custkey % 100) AS loader, CASE o_custkey % 2 WHEN 0 THEN 'pytorch' ELSE 'tensorflow' END AS framework, CASE o_orderkey % 2 WHEN 0 THEN 'batch_size' ELSE 'workers' END AS dimension, CAST(o_orderkey % 8 AS INT) AS setting, CAST(count(*) AS DOUBLE) AS throughput FROM {orders} GROUP BY o_custkey % 100, o_custkey % 2, o_orderkey % 2, o_orderkey % 8",
    "hosts": "SELECT c_name AS host, CAST(c_custkey % 70 + 1 AS INT) AS cores, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 80 + 1 AS DOUBLE) END AS device_gb, CAST(c_custkey % 4 + 5 AS DOUBLE) AS capability, CAST(c_custkey % 299 + 1 AS DOUBLE) AS sample_mb FROM {customer}",
    "words_a": "SELECT DISTINCT concat(c_mktsegment, c_nationkey) AS name, @[c_mktsegment, concat('n', c_nationkey), concat('r', c_nationkey % 5)] AS keywords FROM {customer}",
    "words_b": "SELECT DISTINCT concat('s', s_nationkey) AS name, @[concat('n', s_nationkey), concat('r', s_nationkey % 5), 'MACHINERY'] AS keywords FROM {supplier}",
    "models": "SELECT concat('s', s_suppkey) AS model, CASE s_suppkey % 6 WHEN 0 THEN 'ResNet18' WHEN 1 THEN 'bert-base' WHEN 2 THEN 'VGG16' WHEN 3 THEN 'BiLSTM' WHEN 4 THEN 'MLP' END AS architecture, CASE s_suppkey % 4 WHEN 0 THEN @['quantization'] WHEN 1 THEN @['pruning', 'quantization'] WHEN 2 THEN @['distillation'] END AS techniques, CASE s_suppkey % 3 WHEN 0 THEN 'PyTorch' WHEN 1 THEN 'tensorflow' END AS framework, CASE s_suppkey % 5 WHEN 0 THEN '1.8.0' WHEN 1 THEN '2.4.0' ELSE '3.0' END AS framework_version, CASE s_suppkey % 7 WHEN 0 THEN 'rest_api' WHEN 1 THEN 'BROWSER' WHEN 2 THEN 'edge' END AS deployment, CAST(floor(s_acctbal) * 20000 AS BIGINT) AS parameters, CASE s_nationkey % 3 WHEN 0 THEN 'transfer_learning' WHEN 1 THEN 'federated_learning' END AS source, CASE s_nationkey % 4 WHEN 0 THEN NULL ELSE s_nationkey % 4 = 1 END AS api_exposed, CASE s_nationkey % 5 WHEN 0 THEN 'pickle' WHEN 1 THEN 'onnx' END AS serialization, s_nationkey % 2 = 0 AS container FROM {supplier}",
    "attacks": "SELECT concat('s', l_suppkey) AS model, CASE l_linenumber % 5 WHEN 0 THEN 'fgsm' WHEN 1 THEN 'pgd' WHEN 2 THEN 'carlini_wagner' WHEN 3 THEN 'deepfool' ELSE 'unlisted' END AS attack, CASE WHEN l_quantity < 3 THEN CAST(0 AS DOUBLE) ELSE l_quantity / 50 END AS original_accuracy, l_discount * 2.345678912345 AS adversarial_accuracy, l_tax * 11.2345678912345 AS robustness, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_discount * 1.2345678912345 END AS perturbation, l_tax * 1.2345678912345 AS success_rate FROM {lineitem}",
    "code": "SELECT concat('page-', page_id) AS snippet_id, concat(CASE WHEN html IS NULL THEN '' ELSE html END, chr(10), CASE page_id % 9 " + " ".join(f"WHEN {i} THEN concat('{p}')" for i, p in enumerate(_PIECES)) + " ELSE '' END) AS code FROM {pages}",
    "scripts": "SELECT concat('o', o_orderkey) AS snippet_id, CASE o_orderkey % 6 WHEN 0 THEN concat('def f', o_custkey % 3, '(n):', chr(10), '    for i in range(n):', chr(10), '        g', o_custkey % 17, '(i)', chr(10)) WHEN 1 THEN concat('def h(n):', chr(10), '    return h(n - 1) + h(n - 2)', chr(10)) WHEN 2 THEN concat('import numpy as np', chr(10), 'import os', chr(10), 'np.dot(a, b)', chr(10)) WHEN 3 THEN 'def f(:' WHEN 4 THEN concat('def s(n):', chr(10), '    while n > 1:', chr(10), '        n = n // 2', chr(10)) END AS code FROM {orders}",
    "vectors": "SELECT concat('s', l_suppkey) AS name, l_quantity AS n, CASE l_suppkey % 4 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity * l_quantity WHEN 2 THEN CAST(7 AS DOUBLE) ELSE l_quantity * l_quantity * l_quantity END AS y FROM {lineitem}",
    "mentions": "SELECT concat('c', o_custkey) AS name, CASE o_orderkey % 9 WHEN 0 THEN 'O(n)' WHEN 1 THEN 'O(1) or O(n log n)' WHEN 2 THEN 'O(n^2)' WHEN 3 THEN 'O(log n)' ELSE o_orderpriority END AS said FROM {orders}",
    "scaling": "SELECT l_returnflag AS strategy, l_linenumber AS devices, CAST(count(*) AS DOUBLE) AS throughput FROM {lineitem} WHERE l_linestatus = 'O' AND l_returnflag = 'N' GROUP BY l_returnflag, l_linenumber",
    "suggestions": "SELECT concat('c', o_custkey) AS category, CAST(o_orderkey % 5 + 1 AS INT) AS priority, concat('order ', o_orderkey) AS description, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence_score FROM {orders}",
    "expected": "SELECT concat('part-', p_partkey) AS model, CAST(p_size * 1000 AS DOUBLE) AS params, p_retailprice AS size_mb, CAST(5 AS DOUBLE) AS latency_min_ms, CAST(p_size + 5 AS DOUBLE) AS latency_max_ms FROM {part}",
    "actual": "SELECT concat('part-', l_partkey) AS model, CAST(max(l_quantity) * 1000 AS DOUBLE) AS actual_params, max(l_extendedprice) / 50 AS actual_size_mb, CAST(count(*) AS DOUBLE) AS actual_latency_ms FROM {lineitem} WHERE l_partkey % 10 <> 3 GROUP BY l_partkey",
    "found": "SELECT CASE o_orderkey % 6 WHEN 0 THEN 'nested_loop_with_numpy' WHEN 1 THEN 'pytorch_lstm_loop' WHEN 2 THEN 'repeated_tensor_allocation' WHEN 3 THEN 'unheard_of' ELSE NULL END AS pattern, CAST(o_orderkey AS INT) AS line, CASE WHEN o_custkey % 2 = 0 THEN concat('f', o_custkey) END AS function FROM {orders}",
    "runs": "SELECT concat('o', o_orderkey) AS name, CASE o_orderkey % 6 WHEN 0 THEN 'O(n^2)' WHEN 1 THEN 'O(2^n)' WHEN 2 THEN 'O(n)' WHEN 3 THEN 'O(n^3)' END AS big_o, CASE o_custkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'diffusion' WHEN 2 THEN 'transformer' END AS architecture, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_totalprice / 4000 END AS memory_mb, CASE WHEN o_custkey % 8 = 0 THEN NULL ELSE CAST(o_orderkey % 20 AS DOUBLE) / 100 END AS slowest_s, CASE o_orderkey % 5 WHEN 0 THEN 'for x in y: return x' WHEN 1 THEN 'return f(n - 1)' WHEN 2 THEN 'while x: pass' END AS source FROM {orders}",
    "advised_models": "SELECT concat('part-', p_partkey) AS model, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size * 500000 AS BIGINT) END AS params, CASE p_partkey % 3 WHEN 0 THEN 'Transformer' WHEN 1 THEN 'CNN' END AS architecture, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size % 16 AS INT) END AS heads, CASE p_partkey % 5 WHEN 0 THEN @['Linear', 'LayerNorm'] WHEN 1 THEN @['Conv2d', 'BatchNorm2d'] WHEN 2 THEN @['Conv2d'] END AS layer_kinds, p_retailprice AS memory_mb, CASE p_partkey % 7 WHEN 0 THEN 'pytorch' WHEN 1 THEN 'tensorflow' END AS framework FROM {part}",
    "loops": "SELECT concat('o', o_orderkey) AS snippet_id, CAST(o_custkey AS INT) AS line, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS depth, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 3 > 0 END AS vectorizable, CASE o_orderkey % 6 WHEN 0 THEN 'Arithmetic operations in loop' WHEN 1 THEN 'Iterating over NumPy array' WHEN 2 THEN 'List comprehension' WHEN 3 THEN 'calls with effects' WHEN 4 THEN 'pandas rows' END AS reason FROM {orders}",
    "imports": "SELECT DISTINCT concat('o', l_orderkey) AS snippet_id, CASE l_linenumber WHEN 1 THEN 'numpy' WHEN 2 THEN 'pandas' WHEN 3 THEN 'os' END AS module FROM {lineitem}",
    "evidence": "SELECT CASE event_type WHEN 'view' THEN 'pandas_iterrows' WHEN 'click' THEN 'loader_workers' WHEN 'error' THEN 'item_in_loop' ELSE event_type END AS rule, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(count(*) AS DOUBLE) END AS time_impact, CASE WHEN event_type = 'view' THEN NULL ELSE CAST(count(DISTINCT user_id) AS DOUBLE) END AS memory_impact FROM {events} GROUP BY event_type",
    "measured": "SELECT concat('o', o_orderkey) AS model, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE floor(o_totalprice) * CASE o_orderkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 10000 ELSE 100000 END + 0.1234567891 END AS bytes, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 33 AS INT) END AS batch FROM {orders}",
}


def _tables(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", FACTS[name])))


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The facts as Spark derives them from the given tables."""
    return spark.sql(FACTS[name].replace("@[", "array(").replace("]", ")"), **{t: read(spark, sf_dir, t) for t in _tables(name)})


def derived_sql(name: str, alias: str) -> str:
    """The facts as a common table expression of DuckDB."""
    sql = FACTS[name].replace("@[", "[")
    for table in _tables(name):
        sql = sql.replace(f"{{{table}}}", table)
    return f"{alias} AS ({sql})"
