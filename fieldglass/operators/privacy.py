"""Personal data, quasi-identifiers and the risk they make.

Nulls and edges: a null text matches nothing; an empty table has counts of 0 and no quasi-identifiers, so a low risk; repeated rows count each; column names may hold any
characters; a table without text columns gives no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.guards import named, string_columns
from fieldglass.operators.profile import uniqueness

#: Patterns of personal data.
PII = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\b(\+\d{1,2}\s)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d{4}[- ]?){3}\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}


def pii_scan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, kind, n_rows: rows that match each pattern; all columns and patterns in one pass over whole texts."""
    cols = list(columns or string_columns(df))
    cells = [(c, k, f"n{i}_{j}") for i, c in enumerate(cols) for j, k in enumerate(PII)]
    if not cells:
        return df.sparkSession.createDataFrame([], "column_name string, kind string, n_rows long")
    # what a pattern cannot do without is cheap to look for and spares most texts the pattern
    needs = lambda c, k: named(c).contains("@") if k == "email" else named(c).rlike("[0-9]{3}" if k != "ip_address" else "[0-9]")
    one = df.agg(*[F.count_if(needs(c, k) & named(c).rlike(PII[k])).alias(name) for c, k, name in cells])
    return one.select(F.stack(F.lit(len(cells)), *[x for c, k, name in cells for x in (F.lit(c), F.lit(k), F.col(name))]).alias("column_name", "kind", "n_rows"))


def quasi_identifiers(df: DataFrame) -> DataFrame:
    """column_name, uniqueness for columns that are almost but not quite unique (80 to 100 percent, both excluded)."""
    return uniqueness(df).filter("uniqueness > 80 and uniqueness < 100").select("column_name", "uniqueness")


def risk_level(df: DataFrame) -> DataFrame:
    """n_pii (column and pattern pairs that match), n_quasi, risk: high, medium or low."""
    pii = pii_scan(df).agg(F.count_if(F.col("n_rows") > 0).alias("n_pii"))
    quasi = quasi_identifiers(df).agg(F.count(F.lit(1)).alias("n_quasi"))
    return pii.crossJoin(quasi).withColumn("risk", F.when(F.col("n_pii") > 0, "high").when(F.col("n_quasi") > 0, "medium").otherwise("low"))
