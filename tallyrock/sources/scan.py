"""Parquet scans. Filters on plain columns are pushed to the files, whose statistics skip row groups."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def point(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Rows with one value; null matches nothing."""
    return df.where(F.col(column) == F.lit(value))


def span(df: DataFrame, column: str, low: Any = None, high: Any = None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """Rows inside bounds, either of which may be missing."""
    c = F.col(column)
    if low is not None:
        df = df.where(c > low if low_open else c >= low)
    if high is not None:
        df = df.where(c < high if high_open else c <= high)
    return df


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows."""
    return spark.createDataFrame(rows, schema)
