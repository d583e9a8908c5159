"""Edge cases of the advice operators: anchors typed in by hand, empty tables, nulls."""

from pyspark.sql import functions as F

from fieldglass.operators import advice
from fieldglass.plans import advices


def test_human_bytes(spark):
    sizes = [(0,), (1023,), (1024,), (1152,), (1536,), (1048576,), (5 * 1024**3,), (3 * 1024**4,), (2 * 1024**5,), (None,)]
    got = [r[0] for r in spark.createDataFrame(sizes, "n long").select(advice.human_bytes(F.col("n"))).collect()]
    assert got == ["0.00 B", "1023.00 B", "1.00 KB", "1.12 KB", "1.50 KB", "1.00 MB", "5.00 GB", "3.00 TB", "2048.00 TB", None]


def test_model_rules_at_their_limits(spark):
    rows = [("at", 10_000_000, "Transformer", 8, None, 1024.0, None), ("over", 10_000_001, "Transformer", 9, None, 1024.1, "pytorch"), ("cnn", 1, "CNN", None, ["BatchNorm2d"], None, None), ("nulls", None, None, None, None, None, None)]
    got = advice.model_advice(spark.createDataFrame(rows, advices.MODELS_SCHEMA)).groupBy("model").agg(F.array_sort(F.collect_list("type")).alias("t")).collect()
    assert {r["model"]: r["t"] for r in got} == {"at": ["performance"], "over": ["architecture", "deployment", "memory", "optimization", "performance"]}


def test_memory_line(spark):
    got = {(r["model"], r["batch"]): r["bytes"] for r in advice.memory_sweep(spark.createDataFrame([("a", 1000.0, 10), ("b", 1000.0, 1)], advices.MEASURED_SCHEMA)).collect()}
    assert got["a", 1] == 280.0 and got["a", 16] == 1480.0 and got["b", 1] == 1000.0 and got["b", 2] == 1500.0


def test_empty_tables(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    code = empty("snippet_id string, code string")
    frames = [advice.pattern_advice(empty(advices.FOUND_SCHEMA)), advice.framework_issues(code), advice.compression_openings(code), advice.platform_advice(code), advice.complexity_advice(empty(advices.RUNS_SCHEMA)), advice.model_advice(empty(advices.MODELS_SCHEMA)), advice.loop_advice(empty(advices.LOOPS_SCHEMA), empty(advices.IMPORTS_SCHEMA)), advice.memory_sweep(empty(advices.MEASURED_SCHEMA))]
    assert all(f.count() == 0 for f in frames)
