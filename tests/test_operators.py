import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass import reftables as ref
from fieldglass.operators import codescan, cost, measure, registry, security, telemetry, textscan
from fieldglass.sources import io
from fieldglass.streaming import monitor


def test_complexity_vectors(spark):
    sizes = [10, 20, 30, 40, 50]
    rows = [(n, float(s), float(y)) for n, ys in {"one": [1] * 5, "line": sizes, "square": [s * s for s in sizes]}.items() for s, y in zip(sizes, ys)] + [("few", 1.0, 1.0)]
    got = {r.name: r.complexity for r in measure.best_complexity(spark.createDataFrame(rows, "name string, n double, y double"), ["name"], "n", "y").collect()}
    assert got == {"one": "O(1)", "line": "O(n)", "square": "O(n^2)", "few": "Unknown"}


def test_outlier_flags_need_four_and_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 99.0), *[("b", 5.0)] * 9, ("b", 50.0), *[("c", 1.0)] * 5, ("d", None)], "g string, v double")
    got = {(r.g, r.v) for r in measure.outlier_flags(df, ["g"], "v").filter("is_outlier").collect()}
    assert got == {("b", 50.0)}
    z = {(r.g, r.v) for r in measure.outlier_flags(df, ["g"], "v", "zscore", 2.0).filter("is_outlier").collect()}
    assert z == {("b", 50.0)}
    one = measure.stats(spark.createDataFrame([("a", 3.0)], "g string, v double"), ["g"], "v").first()
    assert (one.stdev, one.variance, one.cv, one["median"]) == (0, 0, 0, 3)


def test_early_stop(spark):
    df = spark.createDataFrame([("f", 1, 1, 0.1), ("f", 1, 2, 9.0), ("f", 1, 3, 0.1), ("f", 2, 1, 0.1), ("g", 1, 1, 0.2)], "f string, n int, trial int, s double")
    assert {(r.f, r.n, r.trial) for r in measure.early_stop(df, ["f"], "n", "trial", "s", 5.0).collect()} == {("f", 1, 1), ("f", 1, 2), ("g", 1, 1)}


TELEMETRY = [("ResNet50", 165.0, 1), ("ResNet50", 165.7, 3), ("MobileNetV2", 480.0, 1), ("MobileNetV2", None, 3)]


def test_telemetry(spark):
    df = spark.createDataFrame(TELEMETRY, "model string, throughput double, day int").withColumn("at", F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.col("day"), F.lit(0), F.lit(0), F.lit(0)))
    stats = {r.model: r for r in telemetry.series_stats(df, ["model"], "throughput").collect()}
    assert abs(stats["ResNet50"].avg - 165.35) < 1e-9 and stats["MobileNetV2"].avg == 240 and stats["MobileNetV2"].min == 0
    assert {r.model: r.day for r in telemetry.latest(df, ["model"], "at", "day", ["throughput"]).collect()} == {"ResNet50": 3, "MobileNetV2": 3}
    assert telemetry.trailing(df, "at", 2).count() == 2 and telemetry.trailing(df, "at", 2, "2024-01-03 00:00:01").count() == 2 and telemetry.trailing(df, "at", 3).count() == 4
    assert telemetry.date_range(df, "at", "2024-01-01", "2024-01-03", "model", ["ResNet50"]).count() == 2


def test_registry(spark):
    p = spark.createDataFrame([("m", "v1", "staging", 1, 1), ("m", "v1", "production", 2, 2), ("m", "v2", "production", 2, 3)], "model string, version string, stage string, promoted_at int, seq int")
    assert {(r.stage, r.version) for r in registry.pointers(p).collect()} == {("staging", "v1"), ("production", "v2")}
    assert {(r.version, r.status) for r in registry.status(p).collect()} == {("v1", "production"), ("v2", "production")}
    bad = spark.createDataFrame([("m", "v3", "canary", 4, 4)], p.schema)
    with pytest.raises(Exception, match="unknown stage"):
        registry.promote(p, bad).collect()
    m = lambda rows: spark.createDataFrame(rows, "metric string, value double")
    got = {r.metric: r for r in registry.compare(m([("a", 2.0), ("z", 0.0), ("only1", 1.0)]), m([("a", 3.0), ("z", 0.0), ("only2", 1.0)])).collect()}
    assert got["a"].pct_change == 50 and got["z"].pct_change == float("inf") and got["only1"].diff is None and got["only2"].v1 is None


def test_registry_document(spark, tmp_path):
    doc = {"models": {"m": {"versions": {"v1": {"created_at": "t", "status": "production", "metrics": {"acc": 0.9}, "tags": {"k": "x"}}}, "promotions": [{"version": "v1", "stage": "production", "promoted_at": "t2", "reason": "r"}]}, 'odd "name"': {"versions": {"1": {"created_at": "t", "status": "new", "metrics": {}, "tags": {}}}, "promotions": []}}}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    versions, promotions = io.read_registry(spark, str(tmp_path / "r.json"))
    assert {(r.model, r.version, r.metrics.get("acc")) for r in versions.collect()} == {("m", "v1", 0.9), ('odd "name"', "1", None)}
    assert [r[:] for r in promotions.collect()] == [("m", 0, "v1", "production", "t2", "r")]
    io.write_registry(versions, promotions, str(tmp_path / "out"))
    merged = {}
    for f in (tmp_path / "out").glob("part-*"):
        for line in f.read_text().splitlines():
            merged |= json.loads(line)["models"]
    assert merged == doc["models"]
    (tmp_path / "bad.json").write_text("{oops")
    assert io.read_registry(spark, str(tmp_path / "bad.json"))[0].count() == 0


def test_sources(spark, tmp_path):
    np.savez(tmp_path / "x.npz", a=np.arange(6.0).reshape(2, 3))
    df, target = io.read_validation(spark, str(tmp_path / "x.npz"))
    assert target == "c2" and [r[:] for r in df.collect()] == [(0, 1, 2), (3, 4, 5)]
    (tmp_path / "x.csv").write_text("a,y\n1,0\n2,1\n")
    df, target = io.read_validation(spark, str(tmp_path / "x.csv"))
    assert target == "y" and df.schema["a"].dataType.simpleString() == "int"
    with pytest.raises(ValueError):
        io.read_validation(spark, "x.bin")
    assert io.synthetic(spark).count() == 1000 and io.synthetic(spark).first() == io.synthetic(spark).first()
    io.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert [r[:] for r in io.file_kinds(df).collect()] == [("csv", 1)]


def test_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE fg_test LOCATION '{tmp_path}/db'")
    try:
        io.create_tables(spark, "fg_test")
        io.create_tables(spark, "fg_test")
        io.append(spark.createDataFrame([("quick", 5, {"k": 1})], "algorithm string, input_size int, parameters map<string,int>"), "analysis_results", "fg_test")
        r = spark.table("fg_test.analysis_results").first()
        assert (r.id, r.algorithm, r.input_size, r.parameters) == (None, "quick", 5, '{"k":1}')
    finally:
        spark.sql("DROP DATABASE fg_test CASCADE")


def test_security_scores(spark):
    counts = security.severity_counts(ref.models(spark), security.findings(ref.models(spark), ref.risks(spark)))
    scores = {r.model: r.score for r in security.security_score(counts).collect()}
    assert scores["plain"] == 100 and scores["resnet"] == 100 - 10 - 5 - 5 and scores["vgg"] == 100 - 10 - 5 * 4 - 2 * 2


def test_unknown_instance_is_an_error(spark):
    fleet = spark.createDataFrame([("x", "aws", "nope", 0.1, 0.1)], "name string, provider string, instance string, gpu_util double, memory_util double")
    with pytest.raises(Exception, match="unknown instance"):
        cost.recommend(ref.prices(spark), fleet).collect()


def test_code_scan(spark):
    got = {r.snippet_id: r for r in codescan.scan(ref.code(spark)).collect()}
    assert got["nested"].loop_depth == 2 and got["nested"].complexity == "O(n^2)" and "nested" not in got["nested"].calls
    assert got["recursion"].complexity == "O(n)" and got["fib"].complexity == "O(2^n)" and got["search"].complexity == "O(log n)"
    assert not got["broken"].parsed and got["empty"].parsed and got["iterrows"].imports == ["pandas"] and "fact>fact" in got["recursion"].edges


def test_rules_compare_severities_by_rank(spark):
    rules = spark.createDataFrame(textscan.RULES, textscan.RULES_SCHEMA)
    high = {r.rule for r in textscan.apply_rules(ref.code(spark), rules, "high").collect()}
    assert high == {"pandas_iterrows", "item_in_loop"}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = monitor.windowed_profile(stream, "ts", "value", late="60 days").writeStream.outputMode("complete").format("memory").queryName("fg_profile").start()
    try:
        query.processAllAvailable()
        got = sorted((r.start, r.n, round(r.mean, 9)) for r in spark.table("fg_profile").collect())
    finally:
        query.stop()
    want = sorted((r.start, r.n, round(r.mean, 9)) for r in monitor.windowed_profile(events, "ts", "value").collect())
    assert got == want and len(got) > 5
