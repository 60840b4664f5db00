"""Inner, left and right joins. No hint is given: Spark sizes the sides, broadcasts only below its
threshold, and splits skewed partitions at run time. A predicate with an equality is hashed or
merged, outer joins too; a predicate without one compares all pairs of rows and fits small sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def qualify(df: DataFrame, ref: str) -> DataFrame:
    """Columns become ``ref.column``, so that tables with equal columns, or a table twice, can meet."""
    return df.alias(ref)


def inner_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "inner")


def left_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left")


def right_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "right")


def join_chain(first: DataFrame, *steps: tuple[DataFrame, Column, str]) -> DataFrame:
    """Joins from left to right: (table, predicate, "inner" | "left" | "right")."""
    for table, on, how in steps:
        first = first.join(table, on, how)
    return first


def without_match(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows of the left side without a partner: what a left join filtered by a null key of the right
    side gives, as an anti join that never builds the padded rows."""
    return left.join(right, on, "left_anti")
