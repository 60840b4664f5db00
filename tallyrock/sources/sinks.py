"""Exports that every task writes for itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal(column: Column, kind: T.DataType) -> Column:
    """A value as SQL text: NULL, TRUE, 12, 'it''s', X'0a'. Dates and instants keep their microseconds."""
    if isinstance(kind, (T.NumericType,)):
        text = column.cast("string")
    elif isinstance(kind, T.BooleanType):
        text = F.when(column, "TRUE").otherwise("FALSE")
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("X'"), F.hex(column), F.lit("'"))
    else:
        text = F.concat(F.lit("'"), F.replace(column.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(column.isNull(), "NULL").otherwise(text)


def as_inserts(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement for each row, in a column ``statement``; write it with ``write.text``."""
    names = ", ".join(f'"{c}"' for c in df.columns)
    items = [literal(F.col(f.name), f.dataType) for f in df.schema.fields]
    return df.select(F.concat(F.lit(f'INSERT INTO "{table}" ({names}) VALUES ('), F.concat_ws(", ", *items), F.lit(");")).alias("statement"))


def csv_lines(df: DataFrame) -> DataFrame:
    """Each row as a line of CSV, in a column ``line``."""
    return df.select(F.to_csv(F.struct("*")).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def table_text(df: DataFrame, rows: int = 1000) -> str:
    """The first rows drawn as a table, for people."""
    return df._show_string(rows, False)


def vertical_text(df: DataFrame, rows: int = 1000) -> str:
    """The first rows with a line for each column, for people."""
    return df._show_string(rows, False, True)
