"""GROUP BY, aggregates and HAVING."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(df: DataFrame, keys: dict[str, Column] | None = None, items: dict[str, Column] | None = None, having: Column | None = None) -> DataFrame:
    """Group by key expressions and compute labelled items; without keys one row, even of no rows.

    ``having`` may use aggregates that are not selected, and no labels of items. An item that is
    neither key nor aggregate goes through ``first_of``."""
    grouped = df.groupBy(*(v.alias(k) for k, v in (keys or {}).items()))
    aggregates = [v.alias(k) for k, v in (items or {}).items()]
    if having is not None:
        aggregates.append(having.alias("_having"))
    out = grouped.agg(*aggregates) if aggregates else df.select(*(v.alias(k) for k, v in (keys or {}).items())).distinct()
    return out.where(F.col("_having")).drop("_having") if having is not None else out
