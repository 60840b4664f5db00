"""Projection, filter, DISTINCT, ORDER BY and LIMIT."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ExecutionError
from ..functions.predicates import definitely, truth


@dataclass(frozen=True)
class Item:
    """An item of a select list. Its label is the alias, or the column's name, or the function's
    name as written, or column<N> by its place from 1."""

    expr: Column
    alias: str | None = None
    column: str | None = None
    function: str | None = None

    def labelled(self, place: int) -> Column:
        return self.expr.alias(self.alias or self.column or self.function or f"column{place}")


def _item(item: Item | Column | str | tuple[str, Column]) -> Item:
    if isinstance(item, Item):
        return item
    if isinstance(item, str):
        return Item(F.col(item), column=item.split(".")[-1])
    if isinstance(item, tuple):
        return Item(item[1], alias=item[0])
    return Item(item)


def project(df: DataFrame, *items: Item | Column | str | tuple[str, Column]) -> DataFrame:
    """Expressions under their labels; equal labels stay apart, as in Spark."""
    return df.select(*(_item(x).labelled(k) for k, x in enumerate(items, 1)))


def constants(spark: SparkSession, *items: Item | Column | tuple[str, Column]) -> DataFrame:
    """SELECT without FROM: one row."""
    return project(spark.range(1), *items)


def star(df: DataFrame, sources: int = 1) -> DataFrame:
    """All columns in table order. Over a join the columns must be named."""
    if sources != 1:
        raise ExecutionError("* over a join: name the columns")
    return df.select("*")


def keep(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is definitely true; a number counts as true unless zero."""
    return df.where(truth(df, predicate))


def asc(key: str | Column) -> Column:
    return (F.col(key) if isinstance(key, str) else key).asc_nulls_first()


def desc(key: str | Column) -> Column:
    return (F.col(key) if isinstance(key, str) else key).desc_nulls_last()


def order(df: DataFrame, *keys: Column) -> DataFrame:
    """Null is the least value: first ascending, last descending. Apply before ``project`` to sort by
    columns that are not selected, after ``aggregate`` to sort by its labels."""
    return df.orderBy(*keys)


def limit(df: DataFrame, rows: int | None = None, offset: int = 0) -> DataFrame:
    """Skip, then take; either may be left out, and 0 rows are none."""
    df = df.offset(offset) if offset else df
    return df if rows is None else df.limit(rows)


def top_k(df: DataFrame, rows: int, *keys: Column) -> DataFrame:
    """Spark keeps the best rows of each task and merges those: no full sort."""
    return df.orderBy(*keys).limit(rows)


def distinct(df: DataFrame) -> DataFrame:
    """Whole rows; nulls are equal."""
    return df.distinct()


def distinct_ordered(df: DataFrame, labels: list[str], *keys: Column) -> DataFrame:
    """DISTINCT ``labels`` in the order of keys that need not be selected: each row stands where its first copy does."""
    ranked = df.withColumn("_copy", F.row_number().over(Window.partitionBy(*labels).orderBy(*keys)))
    return ranked.where("_copy = 1").orderBy(*keys).select(*labels)


__all__ = ["Item", "asc", "constants", "definitely", "desc", "distinct", "distinct_ordered", "keep", "limit", "order", "project", "star", "top_k"]
