"""Constraints on tables as rows, compiled to few plans.

A rule has a name, a kind and what the kind needs:

| kind | fields | a row violates it when |
|-|-|-|
| not_null | columns | any of the columns is missing |
| range | columns (one), low, high | the value lies outside; either end may be open |
| pattern | columns (one), pattern | the text does not match the Java regular expression in full |
| enum | columns (one), allowed | the value is none of the allowed texts |
| key | columns | its values of all columns occur in another row too |
| foreign_key | columns, reference, target | its values do not occur in the target columns of the reference table |
| functional | columns, determines | rows of equal ``columns`` disagree on ``determines`` |

All rules that look at one row share one scan. Each key and functional rule is one grouping, combined before the shuffle and
joined back as a table of the offending groups only; each foreign key is one anti join. Nothing is collected, so violations of any number of rows can be listed.

Nulls and edges: a missing value (NULL or NaN) violates not_null alone; keys, foreign keys and functional rules leave out rows in which any of their
``columns`` is missing, and a missing ``determines`` is a value of its own; an empty table violates nothing; repeated rows
are rows; a rule on a column that the table lacks is an error.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.guards import clean, named

ROW_KINDS = ("not_null", "range", "pattern", "enum")


def _violates(rule: Mapping[str, Any]) -> Column:
    """Whether a row breaks a rule that looks at one row; never null."""
    cols = [named(c) for c in rule["columns"]]
    if rule["kind"] == "not_null":
        return functools.reduce(lambda a, b: a | b, [c.isNull() for c in cols])
    (c,) = cols
    if rule["kind"] == "range":
        low, high = (F.lit(False) if rule.get(end) is None else test(F.lit(rule[end])) for end, test in (("low", lambda x: c < x), ("high", lambda x: c > x)))
        broken = low | high
    elif rule["kind"] == "pattern":
        broken = ~F.coalesce(c.cast("string"), F.lit("")).rlike(f"^(?:{rule['pattern']})$")
    else:
        broken = ~c.cast("string").isin([str(x) for x in rule["allowed"]])
    return F.coalesce(c.isNotNull() & broken, F.lit(False))


def _present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(functools.reduce(lambda a, b: a & b, [named(c).isNotNull() for c in columns]))


def _offending_groups(df: DataFrame, rule: Mapping[str, Any]) -> DataFrame:
    """The groups (g0, g1, ..., n) that break a key or functional rule."""
    keys = [named(c).alias(f"g{i}") for i, c in enumerate(rule["columns"])]
    grouped = _present(df, rule["columns"]).groupBy(*keys)
    if rule["kind"] == "key":
        return grouped.agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # equal structs have one value; a missing field is a value
    value = F.struct(*[named(c) for c in rule["determines"]])
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most")).filter(~F.col("least").eqNullSafe(F.col("most"))).drop("least", "most")


def _orphans(df: DataFrame, rule: Mapping[str, Any], references: Mapping[str, DataFrame]) -> DataFrame:
    """The rows that break a foreign key."""
    target = references[rule["reference"]].select(*[named(c).alias(f"t{i}") for i, c in enumerate(rule["target"])]).distinct()
    same = functools.reduce(lambda a, b: a & b, [named(c) == F.col(f"t{i}") for i, c in enumerate(rule["columns"])])
    return _present(df, rule["columns"]).join(target, same, "left_anti")


def violations(df: DataFrame, rules: Sequence[Mapping[str, Any]], references: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """rule, n_violations: the number of rows that break each rule; one row a rule."""
    df, parts = clean(df), []
    rows = [r for r in rules if r["kind"] in ROW_KINDS]
    if rows:
        one = df.agg(*[F.count_if(_violates(r)).alias(f"n{i}") for i, r in enumerate(rows)])
        parts.append(one.select(F.stack(F.lit(len(rows)), *[x for i, r in enumerate(rows) for x in (F.lit(r["name"]), F.col(f"n{i}"))]).alias("rule", "n_violations")))
    for r in rules:
        if r["kind"] in ("key", "functional"):
            broken = _offending_groups(df, r).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_violations"))
        elif r["kind"] == "foreign_key":
            broken = _orphans(df, r, references or {}).agg(F.count(F.lit(1)).alias("n_violations"))
        elif r["kind"] not in ROW_KINDS:
            raise ValueError(f"unknown kind of rule: {r['kind']}")
        else:
            continue
        parts.append(broken.select(F.lit(r["name"]).alias("rule"), "n_violations"))
    return functools.reduce(DataFrame.unionByName, parts)


def violating_rows(df: DataFrame, rules: Sequence[Mapping[str, Any]], ids: Sequence[str], references: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """rule and the columns ``ids`` of every row that breaks it."""
    df, parts = clean(df), []
    rows = [r for r in rules if r["kind"] in ROW_KINDS]
    own = [named(c) for c in ids]
    if rows:
        broken = F.array_compact(F.array(*[F.when(_violates(r), F.lit(r["name"])) for r in rows]))
        parts.append(df.select(F.explode(broken).alias("rule"), *own))
    for r in rules:
        if r["kind"] in ("key", "functional"):
            groups = _offending_groups(df, r)
            same = functools.reduce(lambda a, b: a & b, [named(c) == F.col(f"g{i}") for i, c in enumerate(r["columns"])])
            hit = df.join(groups, same)
        elif r["kind"] == "foreign_key":
            hit = _orphans(df, r, references or {})
        else:
            continue
        parts.append(hit.select(F.lit(r["name"]).alias("rule"), *own))
    return functools.reduce(DataFrame.unionByName, parts)
