import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.operators import bias, measure, privacy, profile, schema
from fieldglass.operators.quantile import exact_quantiles

AT = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]


def got(df, keys, at=AT, **options):
    return {tuple(r[k] for k in keys): (r.n, [r[f"q{i}"] for i in range(len(at))]) for r in exact_quantiles(df, keys, F.col("v"), at, **options).collect()}


def want(rows, at=AT):
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault((g,), []).append(v)
    return {g: (len(x), np.quantile(x, at).tolist()) for g, x in groups.items()}


def alike(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0] and np.allclose(a[k][1], b[k][1], rtol=1e-12, atol=0), (k, a[k], b[k])


@pytest.mark.parametrize("bins", [6, 4096])
def test_groups_of_every_kind(spark, bins):
    """Smooth, tied, skewed over hundreds of orders, negative, constant, single and empty groups, a null key, one group with most rows."""
    rng = random.Random(bins)
    rows = [("hot", rng.random()) for _ in range(3000)] + [("ties", float(rng.randrange(5))) for _ in range(500)] + [("log", 10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1])) for _ in range(300)]
    rows += [("step", 2.0**i) for i in range(-900, 900, 7)] + [("close", 1e9 + 2.0**-i) for i in range(40)] + [("flat", 7.0)] * 9 + [("one", -3.5), ("none", None), ("none", float("nan")), (None, 1.0), (None, 2.0), ("zero", 0.0), ("zero", -0.0), ("pair", 8e307), ("pair", -8e307)]
    rng.shuffle(rows)
    alike(got(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], bins=bins), want(rows))


def test_infinities_empty_tables_and_no_keys(spark):
    inf = float("inf")
    rows = [(v,) for v in (-inf, 1.0, 2.0, 3.0, inf)]
    assert got(spark.createDataFrame(rows, "v double"), [], [0.0, 0.25, 0.5, 1.0]) == {(): (5, [-inf, 1.0, 2.0, inf])}
    assert got(spark.createDataFrame([], "g string, v double"), ["g"]) == {} == got(spark.createDataFrame([], "v double"), [])


def test_rounds_do_not_grow_with_rows(spark, monkeypatch):
    from fieldglass.operators import quantile

    rounds = []
    settle = quantile.settle
    monkeypatch.setattr(quantile, "settle", lambda df, label: rounds.append(1) or settle(df, label))
    df = spark.range(200_000).select(F.lit("a").alias("g"), (F.rand(3) * 1e6).alias("v"))
    exact_quantiles(df, ["g"], F.col("v"), [0.25, 0.75]).collect()
    assert len(rounds) <= 4
    plan = exact_quantiles(df, ["g"], F.col("v"), [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan


ODD = ["a.b", "it's", "back`tick", "two words", "a'; DROP"]


def test_odd_column_names(spark):
    rows = [(float(i % 7), i, None if i % 5 == 0 else f"t{i % 3}", float(i), 100.0 if i == 39 else 0.0) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b long, c string, d double, e double").toDF(*ODD)
    assert {r.column_name for r in profile.profile(df).collect()} == set(ODD)
    assert {r.column_name: r.n_outliers for r in profile.outlier_counts(df).collect()}["a'; DROP"] == 1
    assert [(r.column_name, r.value) for r in profile.outlier_rows(df, ["it's"], ["a'; DROP", "a.b"]).collect()] == [("a'; DROP", 100.0)]
    assert {(r.column_a, r.column_b): r.r for r in profile.correlation(df).collect()}["it's", "two words"] is not None
    assert {r.column_name: r.feature_type for r in profile.feature_types(df).collect()}["back`tick"] == "categorical"
    assert {r.column_name: r.n_distinct for r in profile.uniqueness(df).collect()} == {"a.b": 7, "it's": 40, "back`tick": 3, "two words": 40, "a'; DROP": 2}
    assert {(r.column_name, r.kind): r.n_rows for r in privacy.pii_scan(df.withColumn("a'; DROP", F.lit("me@x.org"))).collect()}["a'; DROP", "email"] == 40
    assert bias.target_by_group(df, "back`tick", "it's").count() > 3 and bias.parity_gap(df, "back`tick", "a.b").first().min_rate is not None
    assert schema.validate(df, [("a'; DROP", "numeric", 0, 50, None), ("back`tick", "categorical", None, None, ["t0", "t1", "t2"])]).filter("issue = 'above_max'").count() == 1
    assert profile.duplicates(df, ["a.b"]).first().n_groups == 7
    assert profile.value_distribution(df, "back`tick").count() == 3


def test_memory_scaling(spark):
    rows = [("line", float(n), 50.0 + 3.0 * n) for n in range(1, 30)] + [("flat", float(n), 80.0) for n in range(1, 30)] + [("line", -1.0, 9.0), ("line", 4.0, None), ("none", None, 1.0)]
    found = {r.g: r for r in measure.memory_scaling(spark.createDataFrame(rows, "g string, n double, m double"), ["g"], "n", "m", 50.0).collect()}
    assert abs(found["line"].quality - 1) < 1e-6 and abs(found["line"].per_sample - 3) < 1e-9 and abs(found["line"].slope - 3) < 1e-9
    assert found["flat"].quality < 0.6 and "none" not in found


def test_small_groups_take_no_round(spark, monkeypatch):
    from fieldglass.operators import quantile

    written, real = [], quantile.settle
    monkeypatch.setattr(quantile, "settle", lambda df, label: written.append(label) or real(df, label))
    rng = np.random.default_rng(5)
    values = {k: rng.normal(size=n) for k, n in ((0, 1), (1, 2), (2, 501), (None, 64))}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [(7, None)], "k int, v double").repartition(3)
    got = {r.k: (r.n, r.q0, r.q1) for r in quantile.exact_quantiles(rows, ["k"], F.col("v"), [0.5, 0.9]).collect()}
    assert got.keys() == values.keys() and written == ["sizes", "brackets"]
    assert all(got[k] == (len(v), pytest.approx(np.quantile(v, 0.5)), pytest.approx(np.quantile(v, 0.9))) for k, v in values.items())
