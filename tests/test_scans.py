"""Scans of code and fits: plans that grow with the input, and edges of sums from several tasks."""

from pyspark.sql import functions as F

from fieldglass.operators import advice, codescan, measure

CODE = "snippet_id string, code string"


def test_equal_values_from_many_tasks_fit_as_constant(spark):
    rows = spark.range(0, 50 * 13 * 40, 1, 13).select((F.col("id") % 40).alias("k"), (F.floor(F.col("id") / 40) % 50 + 1.0).alias("n"), F.lit(7.0).alias("y"))
    got = measure.best_complexity(rows, ["k"], "n", "y").collect()
    assert len(got) == 40 and {(r.complexity, r.quality) for r in got} == {("O(1)", 0.0)}


def test_fixed_tables_do_not_deal_code_by_their_keys(spark):
    code = spark.createDataFrame([("a", "import torch\nfor a in b: for c in dataLoader\nx.cuda()"), ("b", "import tf\nfor\nin dataset"), ("c", "aws gcp"), ("d", None)], CODE)
    issues, platform = advice.framework_issues(code), advice.platform_advice(code)
    assert {(r.snippet_id, r.framework, r.pattern) for r in issues.collect()} == {("a", "PyTorch", r"for.*in.*dataloader"), ("a", "PyTorch", r"\.cuda\(\)")}
    assert {(r.snippet_id, r.name) for r in platform.collect()} == {("a", "GPU"), ("a", "general"), ("b", "CPU"), ("b", "general"), ("c", "CPU"), ("c", "AWS"), ("d", "CPU"), ("d", "general")}
    for df in (issues, platform):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_code_is_dealt_before_it_is_parsed(spark):
    code = spark.createDataFrame([("a", "f(1)"), ("b", "f(1)"), ("c", None), (None, "def f(:"), ("e", "")], CODE).coalesce(1)
    found = codescan.scan(code)
    assert {r.snippet_id: (r.parsed, list(r.calls)) for r in found.collect()} == {"a": (True, ["f"]), "b": (True, ["f"]), "c": (True, []), None: (False, []), "e": (True, [])}
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().executedPlan().toString()
