"""Security findings by rule tables, and scores.

Nulls and edges: a missing fact meets no rule; a model without findings scores 100; a zero original accuracy counts as robustness 0, a null one is left out; an empty table gives an empty result; repeated findings count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.reftables import ATTACK_WEIGHTS

SEVERITIES = ("critical", "high", "medium", "low")


def findings(models: DataFrame, rules: DataFrame) -> DataFrame:
    """model, type, name, severity, cve: one row per model and rule that holds.

    Each model yields its facts as (field, value) rows that meet the rules in equi-joins: by field and value, and, for rules on parts of
    a name or on sizes, by field. A missing fact meets no rule; a missing number of parameters is 0.
    """
    arch, framework = F.lower(F.coalesce("architecture", F.lit(""))), F.lower(F.coalesce("framework", F.lit("")))
    fact = lambda field, value: F.struct(F.lit(field).alias("field"), value.cast("string").alias("wanted"))
    single = F.array(
        fact("framework version", F.concat_ws(" ", framework, "framework_version")), fact("deployment", F.lower("deployment")), fact("source", F.col("source")),
        fact("api exposed", F.col("api_exposed")), fact("serialization", F.col("serialization")), fact("container", F.col("container")),
    )
    techniques = F.transform(F.array_distinct(F.coalesce("techniques", F.array().cast("array<string>"))), lambda t: fact("technique", t))
    facts = models.select("model", F.inline(F.concat(single, techniques)))
    columns = ["model", "type", "name", "severity", "cve"]
    exact = facts.join(rules, ["field", "wanted"]).select(*columns)
    part = lambda field, value: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"))
    parts = models.select("model", F.inline(F.array(part("architecture contains", arch), part("architecture any", arch), part("parameters over", F.coalesce("parameters", F.lit(0))))))
    holds = F.when(F.col("field") == "architecture contains", F.contains(F.col("value"), F.col("wanted"))).when(F.col("field") == "architecture any", F.expr("rlike(value, wanted)"))
    holds = holds.otherwise(F.expr("try_cast(value as bigint) > try_cast(wanted as bigint)"))
    loose = parts.join(rules, "field").filter(holds)
    return exact.unionByName(loose.select(*columns))


def severity_counts(models: DataFrame, found: DataFrame) -> DataFrame:
    """model, critical, high, medium, low, total; models without findings have zeros."""
    counts = found.groupBy("model").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count(F.lit(1)).alias("total"))
    return models.select("model").join(counts, "model", "left").na.fill(0)


def security_score(counts: DataFrame, weights: tuple[int, int, int, int] = (20, 10, 5, 2)) -> DataFrame:
    """model, score: 100 less the weighted findings, within 0 and 100."""
    lost = sum((F.col(s) * w for s, w in zip(SEVERITIES, weights)), F.lit(0))
    return counts.select("model", F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)).cast("long").alias("score"))


def band(score: Column) -> Column:
    """Robustness in words."""
    return F.when(score < 20, "very low").when(score < 40, "low").when(score < 60, "medium").when(score < 80, "high").otherwise("very high")


def robustness(attacks: DataFrame) -> DataFrame:
    """model, score, level: mean of adversarial over original accuracy (0 where the original is 0), times 100."""
    r = F.when(F.col("original_accuracy") == 0, 0.0).otherwise(F.try_divide("adversarial_accuracy", "original_accuracy"))
    out = attacks.groupBy("model").agg((F.coalesce(F.avg(r), F.lit(0.0)) * 100).alias("score"))
    return out.withColumn("level", band(F.col("score")))


def weighted_robustness(attacks: DataFrame) -> DataFrame:
    """model, score, level: robustness weighted by attack; every weight (0.1 for unknown attacks) is divided by the sum of the known ones."""
    known = F.create_map(*[F.lit(x) for pair in ATTACK_WEIGHTS.items() for x in pair])[F.col("attack")]
    total = F.sum(F.coalesce(known, F.lit(0.0)))
    out = attacks.groupBy("model").agg((F.coalesce(F.sum(F.coalesce(known, F.lit(0.1)) * F.col("robustness")), F.lit(0.0)) / F.when(total == 0, 1.0).otherwise(total) * 100).alias("score"))
    return out.withColumn("level", band(F.col("score")))


def robustness_details(attacks: DataFrame) -> DataFrame:
    """model, avg_perturbation, avg_success, worst_case, consistency, n_attacks."""
    return attacks.groupBy("model").agg(
        F.coalesce(F.avg("perturbation"), F.lit(0.0)).alias("avg_perturbation"), F.coalesce(F.avg("success_rate"), F.lit(0.0)).alias("avg_success"),
        F.coalesce(F.min("robustness"), F.lit(1.0)).alias("worst_case"), (1 - F.coalesce(F.stddev_pop("robustness"), F.lit(0.0))).alias("consistency"), F.count(F.lit(1)).alias("n_attacks"),
    )


def gates(models: DataFrame, rules: DataFrame) -> DataFrame:
    """model, gate: the quality gates a model fails. ``models``: model, metric, value; ``rules``: metric, direction (max or min), threshold."""
    fails = F.when(F.col("direction") == "max", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return models.join(F.broadcast(rules), "metric").filter(fails).select("model", F.col("metric").alias("gate"))


