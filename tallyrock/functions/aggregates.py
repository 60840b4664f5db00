"""The dialect's aggregates. Nulls are skipped; without values all but the counts are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_all() -> Column:
    return F.count(F.lit(1))


def count_of(value: Column) -> Column:
    return F.count(value)


def count_distinct_of(value: Column) -> Column:
    return F.count_distinct(value)


def sum_of(value: Column, distinct: bool = False) -> Column:
    return F.sum_distinct(value) if distinct else F.sum(value)


def avg_of(value: Column, distinct: bool = False) -> Column:
    """Always a double or decimal, whatever the values."""
    return F.sum_distinct(value) / F.count_distinct(value) if distinct else F.avg(value)


def min_of(value: Column) -> Column:
    return F.min(value)


def max_of(value: Column) -> Column:
    return F.max(value)


def first_of(value: Column) -> Column:
    """A value of some row of the group, for items that are neither keys nor aggregates."""
    return F.first(value)
