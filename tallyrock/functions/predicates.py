"""Three-valued predicates: null is unknown, and only what is definitely true passes a filter."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExecutionError


def truth(df: DataFrame, value: Column) -> Column:
    """A boolean from a boolean or number (not zero); texts have no truth."""
    kind = df.select(value).schema[0].dataType
    if isinstance(kind, T.NumericType):
        return value != 0
    if isinstance(kind, (T.BooleanType, T.NullType)):
        return value.cast("boolean")
    raise ExecutionError(f"a {kind.simpleString()} has no truth value")


def definitely(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def is_false(predicate: Column) -> Column:
    """Definitely false: what a CHECK rejects."""
    return F.coalesce(~predicate, F.lit(False))


def between(value: Column, low: Column | Any, high: Column | Any) -> Column:
    return value.between(low, high)


def not_between(value: Column, low: Column | Any, high: Column | Any) -> Column:
    return ~value.between(low, high)


def in_list(value: Column, items: list[Any]) -> Column:
    """Unknown if the value is null, or is not found and a null is listed; false for no items."""
    return value.isin(*items) if items else F.lit(False)


def not_in_list(value: Column, items: list[Any]) -> Column:
    return ~in_list(value, items)


def like(text: Column, pattern: str) -> Column:
    """% and _ as wildcards and no escape: a backslash is itself."""
    return F.like(text, F.lit(pattern), F.lit("\x01"))


def not_like(text: Column, pattern: str) -> Column:
    return ~like(text, pattern)
