"""Every registered query against its DuckDB SQL on the smallest test tables."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    found = duck.execute(f"SELECT {', '.join(f'\"{x}\"' for x in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted((tuple(plain(v) for v in r) for r in found), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_distinct_order_ties(spark, tmp_path):
    """Brands of equal least prices stand by name, in order; a null price or brand comes last."""
    rows = [(1, "d", 2.0), (2, "c", 1.0), (3, "b", 1.0), (4, "a", 1.0), (5, "a", None), (6, "e", None), (7, None, 1.0), (8, "f", 0.5), (9, "g", 1.0)]
    name = "distinct_order_unselected"
    for k, some in enumerate((rows, rows[:2] + rows[4:8])):
        spark.createDataFrame(some, "p_partkey long, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/{k}/part.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/{k}/part.parquet/*.parquet'")
        expected = con.execute(entry.oracle_sql()[name]).fetchall()
        assert [tuple(r) for r in entry.queries()[name](spark, f"{tmp_path}/{k}").collect()] == expected
    assert expected[-1] == ("a", None)
