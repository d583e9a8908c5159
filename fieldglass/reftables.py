"""Reference tables and fixture rows as inline DataFrames. All values below are fixed values, stated as such."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PRICES_SCHEMA = "provider string, instance string, cost double, gpus int, gpu_type string, inferentia_chips int, ram int"
PRICES = [
    ("aws", "p3.2xlarge", 3.06, 1, "V100", None, 61),
    ("aws", "p3.8xlarge", 12.24, 4, "V100", None, 244),
    ("aws", "p3.16xlarge", 24.48, 8, "V100", None, 488),
    ("aws", "p4d.24xlarge", 32.77, 8, "A100", None, 320),
    ("aws", "g4dn.xlarge", 0.526, 1, "T4", None, 16),
    ("aws", "g4dn.12xlarge", 3.912, 4, "T4", None, 192),
    ("aws", "g5.xlarge", 1.006, 1, "A10G", None, 24),
    ("aws", "g5.12xlarge", 8.208, 4, "A10G", None, 192),
    ("aws", "inf1.xlarge", 0.369, None, None, 1, 8),
    ("aws", "inf1.6xlarge", 1.842, None, None, 4, 48),
    ("gcp", "n1-standard-8-nvidia-tesla-t4", 0.752, 1, "T4", None, 30),
    ("gcp", "n1-standard-8-nvidia-tesla-v100", 2.48, 1, "V100", None, 30),
    ("gcp", "a2-highgpu-1g", 3.67, 1, "A100", None, 85),
    ("gcp", "a2-highgpu-4g", 13.92, 4, "A100", None, 340),
    ("azure", "Standard_NC6s_v3", 3.06, 1, "V100", None, 112),
    ("azure", "Standard_NC24s_v3", 12.24, 4, "V100", None, 448),
    ("azure", "Standard_ND40rs_v2", 26.7, 8, "V100", None, 672),
    ("azure", "Standard_NC4as_T4_v3", 0.526, 1, "T4", None, 28),
]

GPUS_SCHEMA = "pos int, gpu string, tflops double, gbps double, architecture string"
GPUS = [
    (1, "V100", 15.7, 900.0, "Volta"),
    (2, "A100", 19.5, 1555.0, "Ampere"),
    (3, "A100-80GB", 19.5, 2039.0, "Ampere"),
    (4, "A10", 31.2, 600.0, "Ampere"),
    (5, "A30", 10.3, 933.0, "Ampere"),
    (6, "A40", 37.4, 696.0, "Ampere"),
    (7, "T4", 8.1, 320.0, "Turing"),
    (8, "RTX 2080 Ti", 13.4, 616.0, "Turing"),
    (9, "RTX 3090", 35.6, 936.0, "Ampere"),
    (10, "RTX 4090", 82.6, 1008.0, "Ada Lovelace"),
    (11, "RTX 3080", 29.8, 760.0, "Ampere"),
    (12, "RTX 4080", 48.7, 717.0, "Ada Lovelace"),
    (13, "RTX 3070", 20.3, 448.0, "Ampere"),
    (14, "RTX 4070", 29.1, 504.0, "Ada Lovelace"),
    (15, "GTX 1080 Ti", 11.3, 484.0, "Pascal"),
    (16, "MI100", 23.1, 1229.0, "CDNA"),
    (17, "MI250X", 47.9, 3277.0, "CDNA2"),
    (18, "RTX 40", 40.0, 800.0, "Ada Lovelace"),
    (19, "RTX 30", 30.0, 700.0, "Ampere"),
    (20, "RTX 20", 15.0, 550.0, "Turing"),
]
DEFAULT_GPU = (10.0, 500.0)

#: kind of rule, what it tests, type and name of the finding, severity, cve
RISKS_SCHEMA = "field string, wanted string, type string, name string, severity string, cve string"
RISKS = [
    ("architecture contains", "vgg", "architecture", "vgg", "medium", "CVE-2020-12345"),
    ("architecture contains", "alexnet", "architecture", "alexnet", "medium", "CVE-2020-12346"),
    ("architecture contains", "lstm", "architecture", "lstm", "low", "CVE-2021-54321"),
    ("technique", "quantization", "optimization", "quantization", "medium", "CVE-2021-98765"),
    ("technique", "pruning", "optimization", "pruning", "low", "CVE-2021-56789"),
    ("framework version", "pytorch 1.8.0", "framework", "pytorch 1.8.0", "high", "CVE-2021-12345"),
    ("framework version", "tensorflow 2.4.0", "framework", "tensorflow 2.4.0", "medium", "CVE-2021-23456"),
    ("deployment", "rest_api", "deployment", "rest_api", "medium", "CVE-2022-12345"),
    ("deployment", "browser", "deployment", "browser", "high", "CVE-2022-23456"),
    ("parameters over", "100000000", "complexity", "over_parameterization", "medium", None),
    ("architecture any", "vgg|alexnet|lenet", "architecture", "outdated_architecture", "low", None),
]
MORE_RISKS = [
    ("source", "transfer_learning", "model_poisoning", "transfer_learning", "critical", "CVE-2022-24834"),
    ("source", "federated_learning", "model_poisoning", "federated_learning", "high", "CVE-2022-35647"),
    ("api exposed", "true", "inference", "model_inversion", "high", "CVE-2022-29457"),
    ("api exposed", "true", "inference", "membership_inference", "medium", "CVE-2022-31567"),
    ("api exposed", "true", "inference", "model_stealing", "medium", "CVE-2022-28756"),
    ("serialization", "pickle", "deployment", "insecure_serialization", "critical", "CVE-2022-21669"),
    ("container", "true", "deployment", "container_escape", "high", "CVE-2022-0185"),
    ("api exposed", "true", "deployment", "api_security", "high", "CVE-2022-31137"),
    ("technique", "quantization", "quantization", "bit_flipping", "medium", None),
    ("technique", "quantization", "quantization", "precision_attacks", "medium", None),
    ("architecture any", "transformer|bert|gpt", "architecture_specific", "attention_manipulation", "high", None),
    ("architecture any", "cnn|conv|resnet|vgg", "architecture_specific", "feature_map_manipulation", "medium", None),
    ("architecture any", "rnn|lstm|gru", "architecture_specific", "sequence_manipulation", "medium", None),
]
MODELS_SCHEMA = "model string, architecture string, techniques array<string>, framework string, framework_version string, deployment string, parameters long, source string, api_exposed boolean, serialization string, container boolean"
MODELS = [
    ("resnet", "ResNet18", ["quantization"], "PyTorch", "1.8.0", "rest_api", 11689512, "transfer_learning", True, "pickle", True),
    ("vgg", "VGG16", ["pruning", "quantization"], "TensorFlow", "2.4.0", "browser", 138357544, None, False, "onnx", False),
    ("bert", "bert-base", [], "pytorch", "2.0.1", None, 109482240, "federated_learning", True, "safetensors", None),
    ("seq", "BiLSTM", None, "jax", None, "edge", 4000000, None, None, None, None),
    ("alex", "AlexNet", ["distillation"], None, None, "REST_API", 61100840, None, False, "pickle", False),
    ("plain", "MLP", [], "pytorch", "1.8.1", None, 1000, None, False, None, False),
]

ATTACK_WEIGHTS = {"fgsm": 0.1, "pgd": 0.2, "deepfool": 0.2, "carlini_wagner": 0.25, "boundary_attack": 0.15, "spatial_transformation": 0.1}
ATTACKS_SCHEMA = "model string, attack string, original_accuracy double, adversarial_accuracy double, robustness double, perturbation double, success_rate double"
ATTACKS = [
    ("resnet", "fgsm", 0.85, 0.45, 0.53, 0.03, 0.47),
    ("resnet", "pgd", 0.85, 0.3, 0.35, 0.03, 0.65),
    ("resnet", "carlini_wagner", 0.85, 0.2, 0.24, 0.5, 0.76),
    ("bert", "fgsm", 0.9, 0.81, 0.9, None, 0.1),
    ("bert", "home_made", 0.9, 0.72, 0.8, 0.1, None),
    ("vgg", "deepfool", 0.0, 0.0, None, 0.2, 1.0),
]

CODE_SCHEMA = "snippet_id string, code string"
CODE = [
    ("iterrows", "import pandas as pd\nfor i, row in df.iterrows():\n    total += row['a']\n"),
    ("nested", "import numpy as np\ndef pairs(data):\n    out = []\n    for i in range(len(data)):\n        for j in range(len(data)):\n            out.append(data[i] * data[j])\n    return out\n"),
    ("item", "import torch\nfor x in loader: total += model(x).item()\nloader = DataLoader(ds, batch_size=32)\n"),
    ("workers", "import torch\nloader = DataLoader(ds, batch_size=64, num_workers=4)\nseq_len=128\n"),
    ("attention", "import torch.nn as nn\nclass Encoder(nn.Module):\n    def __init__(self):\n        self.attention = nn.MultiheadAttention(64, 8)\n        self.fc = nn.Linear(64, 10)\n"),
    ("cnn", "import tensorflow as tf\nmodel = Conv2D(32, kernel_size=3, stride=1, padding='same')\nx = maxpool(model)\n"),
    ("recursion", "def fact(n):\n    return 1 if n < 2 else n * fact(n - 1)\n"),
    ("fib", "def fib(n):\n    return n if n < 2 else fib(n - 1) + fib(n - 2)\n"),
    ("search", "def binary_search(a, x):\n    lo, hi = 0, len(a)\n    while lo < hi:\n        mid = (lo + hi) // 2\n        if a[mid] < x:\n            lo = mid + 1\n        else:\n            hi = mid\n    return lo\n"),
    ("cloud", "import jax.numpy as jnp\nimport boto3\nclient = boto3.client('s3')  # aws sagemaker\nkmeans(jnp.ones(3))\n"),
    ("broken", "def f(:\n  pass"),
    ("empty", ""),
]


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, PRICES_SCHEMA)


def gpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GPUS, GPUS_SCHEMA)


def risks(spark: SparkSession, more: bool = False) -> DataFrame:
    return spark.createDataFrame(RISKS + (MORE_RISKS if more else []), RISKS_SCHEMA)


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, MODELS_SCHEMA)


def attacks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ATTACKS, ATTACKS_SCHEMA)


def code(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODE, CODE_SCHEMA)


def values_sql(rows: list[tuple], schema: str, name: str) -> str:
    """A common table expression with these rows, typed as in the schema; for the DuckDB side."""
    kinds = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}
    cols = [x.strip().split(" ", 1) for x in schema.split(", ")]

    def lit(v, kind):
        if v is None:
            return f"CAST(NULL AS {kinds[kind]})"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "CAST([" + ", ".join(lit(x, "string") for x in v) + "] AS VARCHAR[])"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v!r} AS {kinds[kind]})"

    body = ", ".join("(" + ", ".join(lit(v, c[1]) for v, c in zip(row, cols)) + ")" for row in rows)
    return f"{name}({', '.join(c[0] for c in cols)}) AS (VALUES {body})"
