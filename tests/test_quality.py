"""The fixtures of people and edge tables, with values worked out by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.functions.special import upper_gamma
from fieldglass.operators import bias, drift, privacy, profile, schema
from fieldglass.plans import reports

PEOPLE = [(1, "Alice", 25, 50000, "HR"), (2, "Bob", 30, 60000, "IT"), (3, "Charlie", 35, 70000, "Finance"), (4, "David", 40, 80000, "IT"), (5, "Eve", 45, 90000, "HR"), (5, "Frank", 50, 100000, "Finance"), (7, None, 200, 110000, "IT")]
SCHEMA = "id long, name string, age long, salary long, department string"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, SCHEMA)


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_profile(people):
    assert profile.basic_profile(people).first()[:] == (7, 5)
    got = rows(profile.profile(people), "column_name")
    assert round(got["name"].completeness, 6) == round(600 / 7, 6) and got["id"].completeness == 100
    assert round(got["id"].uniqueness, 6) == round(600 / 7, 6)
    assert got["age"].n_outliers == 1 and got["salary"].n_outliers == 0 and got["name"].n_outliers is None
    assert [r.value for r in profile.outlier_rows(people, ["id"], ["age", "salary"]).collect()] == [200.0]
    b = rows(profile.outlier_bounds(people, ["age"]), "column_name")["age"]
    assert (b.q1, b.q3, b.lower, b.upper) == (32.5, 47.5, 10.0, 70.0)
    assert rows(profile.missing(people), "column_name")["*"].n_missing == 1


def test_duplicates_and_distribution(people):
    assert profile.duplicates(people, ["id"]).first()[:] == (1, 1)
    assert profile.duplicates(people).first()[:] == (0, 0)
    assert {r.value: r.n for r in profile.value_distribution(people, "department").collect()} == {"IT": 3, "HR": 2, "Finance": 2}


def test_correlation(people, spark):
    got = rows(profile.correlation(people), "column_a", "column_b")
    assert round(got["age", "salary"].r, 6) == 0.715404 and abs(got["id", "id"].r - 1) < 1e-12 and len(got) == 9
    constant = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (float("nan"), 3.0)], "a double, b double")
    assert rows(profile.correlation(constant), "column_a", "column_b")["a", "b"].r is None
    assert profile.correlation(people.select("age", "name")).count() == 0
    top = profile.strong_correlation(profile.correlation(people)).collect()
    assert {(r.column_a, r.column_b) for r in top} >= {("age", "salary"), ("salary", "age")}


def test_quantiles_equal_sorting(spark):
    rng = random.Random(1)
    data = [(rng.gauss(0, 1), float(rng.randrange(5)), None if k % 3 else 1.5) for k in range(3000)]
    at = [0.0, 0.25, 0.5, 0.99, 1.0]
    for i, (name, r) in enumerate(sorted(rows(profile.quantiles(spark.createDataFrame(data, "a double, b double, c double"), ["a", "b", "c"], at), "column_name").items())):
        direct = np.quantile([x[i] for x in data if x[i] is not None], at)
        assert all(abs(x - y) < 1e-9 for x, y in zip(r[1:], direct)), name


def test_feature_types(people, spark):
    assert {k: r.feature_type for k, r in rows(profile.feature_types(people), "column_name").items()} == {"id": "numeric", "name": "categorical", "age": "numeric", "salary": "numeric", "department": "categorical"}
    n = 40
    df = spark.createDataFrame([(k % 2, f"2024-01-{k:02d}" if k < 29 else "x", f"2024-01-{k:02d}" if k < 27 else f"text {k}", k % 3 == 0, ("low", "medium", "HIGH", *[f"w{j}" for j in range(30)])[k % 33], f"c{k % 10}") for k in range(n)], "two int, dated string, undated string, flag boolean, scale string, ten string")
    got = {k: r.feature_type for k, r in rows(profile.feature_types(df), "column_name").items()}
    assert got == {"two": "binary", "dated": "datetime", "undated": "text", "flag": "binary", "scale": "ordinal", "ten": "categorical"}


@pytest.mark.parametrize("data", [[], [(None, None)], [(1.0, "a")], [(float("nan"), None), (2.0, "b")]])
def test_edge_tables(spark, data):
    df = spark.createDataFrame(data, "x double, s string")
    valid = [r[0] for r in data if r[0] is not None and r[0] == r[0]]
    got = rows(profile.completeness(df), "column_name")["x"]
    assert got.n_missing == len(data) - len(valid) and (got.completeness is None) == (not data)
    assert rows(profile.uniqueness(df), "column_name")["x"].n_distinct == len(set(valid))
    assert profile.outlier_counts(df).first().n_outliers == 0
    assert profile.duplicates(df).first()[:] == (0, 0)
    assert privacy.risk_level(df).first().risk in ("low",)


def test_schema(people, spark):
    issues = {(r.column_name, r.issue, r.detail) for r in schema.validate(people, [("age", "numeric", 0.0, 100.0, None), ("department", "categorical", None, None, ["HR", "IT"]), ("gone", "numeric", None, None, None), ("name", "numeric", None, None, None)]).collect()}
    assert issues == {("age", "above_max", "200.0"), ("department", "invalid_category", "Finance"), ("gone", "missing", None), ("name", "wrong_type", "string"), ("id", "unexpected", None), ("salary", "unexpected", None)}
    changed = people.drop("department").withColumn("new_column", F.lit(1))
    assert {(r.change, r.column_name) for r in schema.schema_drift(changed, people).collect()} == {("added", "new_column"), ("removed", "department")}


def test_privacy(people, spark):
    texts = spark.createDataFrame([("mail a.b@c.org", "123-45-6789"), ("10.0.0.1 and 4111 1111 1111 1111", None), ("call 555-123-4567", "x")], "a string, b string")
    got = {(r.column_name, r.kind): r.n_rows for r in privacy.pii_scan(texts).collect()}
    assert got["a", "email"] == got["a", "ip_address"] == got["a", "credit_card"] == got["a", "phone"] == got["b", "ssn"] == 1 and got["b", "email"] == 0
    assert {r.column_name for r in privacy.quasi_identifiers(people).collect()} == {"id", "name"}
    assert privacy.risk_level(people).first()[:] == (0, 2, "medium") and privacy.risk_level(texts).first().risk == "high"


def test_bias(people):
    means = {r.attribute: r.value for r in bias.target_by_group(people.withColumn("pay", F.col("salary").cast("double")), "department", "pay").collect()}
    assert means == {"HR": 70000.0, "IT": 250000 / 3, "Finance": 85000.0}
    gap = bias.parity_gap(people.withColumn("old", (F.col("age") > 40).cast("int")), "department", "old").first()
    assert gap[:] == (1 / 3, 0.5, 0.5 - 1 / 3)


def test_drift(spark, people):
    rng = random.Random(3)
    a, b = [rng.gauss(0, 1) for _ in range(300)], [rng.gauss(0.4, 1) for _ in range(200)]
    frame = lambda xs: spark.createDataFrame([(x,) for x in [*xs, None, float("nan")]], "x double")
    got = drift.ks(frame(a), frame(b), "x", buckets=7).first()
    want = max(abs(sum(v <= x for v in a) / 300 - sum(v <= x for v in b) / 200) for x in a + b)
    assert abs(got.d - want) < 1e-12 and (got.n_reference, got.n_current) == (300, 200) and got.drifted
    same = drift.ks(frame(a), frame(a), "x").first()
    assert same.d == 0 and same.p_value == 1 and not same.drifted
    text = lambda xs: spark.createDataFrame([(x,) for x in xs], "x string")
    chi = drift.chi_square_test(text("a" * 50 + "b" * 50), text("a" * 20 + "b" * 30), "x").first()
    assert abs(chi.statistic - 2.0) < 1e-12 and chi.dof == 1 and abs(chi.p_value - math.erfc(1.0)) < 1e-9
    new = drift.chi_square_test(text("aa"), text("ab"), "x").first()
    assert new.statistic == float("inf") and new.p_value == 0 and new.reason == "new category"
    shift = drift.category_shift(text("aab"), text("abb"), "x").collect()
    assert abs(shift[0].total_variation - 1 / 3) < 1e-12 and [r.value for r in shift] == ["a", "b"]


def test_upper_gamma(spark):
    xs = (0.0, 0.01, 0.5, 1.5, 5.0, 30.0, float("inf"))
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", *[upper_gamma(F.lit(a), F.col("x")).alias(f"a{i}") for i, a in enumerate((1.0, 0.5, 2.0, 500.0))]).collect():
        x = r.x
        assert abs(r.a0 - math.exp(-x)) < 1e-12
        assert abs(r.a1 - math.erfc(math.sqrt(x))) < 1e-12
        assert abs(r.a2 - ((1 + x) * math.exp(-x) if x < 99 else 0)) < 1e-12
        assert r.a3 == (0 if x > 99 else pytest.approx(1))
    big = spark.range(1).select(upper_gamma(F.lit(5000.0), F.lit(5000.0)).alias("p"), upper_gamma(F.lit(5000.0), F.lit(5100.0)).alias("q")).first()
    assert abs(big.p - 0.498119) < 1e-5 and abs(big.q - 0.0796) < 2e-3  # near the normal distribution


def test_reordering_rows_changes_nothing(people):
    again = people.repartition(5, "name").orderBy(F.desc("salary"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(profile.profile(people)) == key(profile.profile(again))


def test_reports(people):
    sections = reports.quality_sections(people, "department", "id")
    text, page, doc = reports.markdown("People", sections), reports.html_page("People <1>", sections), reports.as_json(sections)
    assert "## Outliers" in text and "| age | 1 |" in text and "People &lt;1&gt;" in page and "<td>age</td>" in page and '"risk": "medium"' in doc
    assert {(r["issue"], r["column"]) for r in sections["Recommendations"]} >= {("missing", "name"), ("outliers", "age")}
    assert reports.markdown("x", {"a": [], "b": "words", "c": [{"k": "p|q"}]}).count("\n") > 5


def test_pii_anchors(spark):
    """Rows of the documents of scale 0.01 that match, as typed in; independent of the library's constants."""
    got = {r.kind: r.n_rows for r in privacy.pii_scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), ["text"]).collect()}
    assert got == {"email": 11, "phone": 18, "ssn": 0, "credit_card": 24, "ip_address": 25}


@pytest.mark.parametrize("kind,text", [("phone", "(212) 555-0199"), ("phone", "+1 212 555 0199"), ("phone", "212.555.0199"), ("credit_card", "4111-1111 1111 1111"), ("credit_card", "4111111111111111"), ("ip_address", "1.2.3.4"), ("email", "a.b@c.de"), ("ssn", "123-45-6789")])
def test_pii_shapes(spark, kind, text):
    got = {r.kind: r.n_rows for r in privacy.pii_scan(spark.createDataFrame([(f"call {text} now",), (None,), ("2125550199",)], "t string")).collect()}
    assert got[kind] == 1


def test_reports_are_whole_or_fail(spark, monkeypatch):
    monkeypatch.setattr(reports, "MOST_ROWS", 250)
    assert reports.markdown("x", {"a": spark.range(250)}).count("\n| ") == 251
    for render in (reports.markdown, reports.html_page):
        with pytest.raises(ValueError):
            render("x", {"a": spark.range(251)})
    with pytest.raises(ValueError):
        reports.as_json({"a": spark.range(251)})
