"""Every registered query against its DuckDB equivalent at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(frame, columns):
    frame = frame[columns].convert_dtypes()  # whole numbers with nulls are floats in one engine's frames
    return frame.astype(object).where(frame.notna(), None).astype(str).sort_values(columns).reset_index(drop=True)


def test_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert canonical(got, columns).equals(canonical(want, columns)), name


def test_entry(spark):
    assert entry.entry(spark).count() == 11
