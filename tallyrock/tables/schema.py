"""Declarations of tables: the eight column types, constraints and indexes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError


def sql_text(value: Any) -> str:
    """A value as an SQL literal."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{value.hex().upper()}'"
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


@dataclass(frozen=True)
class Kind:
    """A column type: its name, and a length or precision and scale."""

    name: str
    size: int = 0
    scale: int = 0

    def spark(self) -> T.DataType:
        plain = {"INT": T.IntegerType(), "BIGINT": T.LongType(), "VARCHAR": T.StringType(), "BOOL": T.BooleanType(), "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "BLOB": T.BinaryType()}
        return T.DecimalType(self.size, self.scale) if self.name == "DECIMAL" else plain[self.name]

    def __str__(self) -> str:
        return {"VARCHAR": f"VARCHAR({self.size})", "DECIMAL": f"DECIMAL({self.size},{self.scale})"}.get(self.name, self.name)

    def cast(self, value: Column, given: T.DataType) -> tuple[Column, Column]:
        """The value in this type, and whether a non-null value fits it. Nothing is rounded or cut."""
        text = value.cast("string")
        boolean, number = isinstance(given, T.BooleanType), isinstance(given, T.NumericType)
        if self.name in ("INT", "BIGINT"):
            out = value.try_cast(self.spark())
            if boolean:
                return out, F.lit(False)
            if number:
                return out, out.isNotNull() & (out.cast("double") == value.cast("double"))
            return out, F.coalesce(text.rlike(r"^[+-]?\d+$"), F.lit(False)) & out.isNotNull()
        if self.name == "DECIMAL":
            out = text.try_cast(self.spark())
            return out, out.isNotNull() & (out == text.try_cast(T.DecimalType(38, 18)))
        if self.name == "VARCHAR":
            return text, F.octet_length(text) <= self.size
        if self.name == "BOOL":
            if boolean:
                return value, F.lit(True)
            word = F.lower(text)
            out = F.when(word.isin("true", "t", "1"), True).when(word.isin("false", "f", "0"), False)
            return out, out.isNotNull()
        if self.name == "DATE":
            out = value.try_cast("date")
            return out, out.isNotNull() & (text.rlike(r"^\d{4}-\d{2}-\d{2}$") if isinstance(given, T.StringType) else F.lit(True))
        if self.name == "DATETIME":
            out = value.try_cast("timestamp_ntz")
            return out, out.isNotNull() & (text.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?)?$") if isinstance(given, T.StringType) else F.lit(True))
        if isinstance(given, (T.StringType, T.BinaryType)):
            return value.cast("binary"), F.lit(True)
        return F.lit(None).cast("binary"), F.lit(False)


INT, BIGINT, BOOL, DATE, DATETIME, BLOB = (Kind(n) for n in ("INT", "BIGINT", "BOOL", "DATE", "DATETIME", "BLOB"))


def VARCHAR(size: int) -> Kind:
    if not 0 < size <= 65535:
        raise SchemaError("VARCHAR takes 1 to 65535 bytes")
    return Kind("VARCHAR", size)


def DECIMAL(precision: int, scale: int = 0) -> Kind:
    if not 0 < precision <= 18 or not 0 <= scale <= precision:
        raise SchemaError("DECIMAL takes a precision of 1 to 18 and a scale up to it")
    return Kind("DECIMAL", precision, scale)


@dataclass(frozen=True)
class Column_:
    name: str
    kind: Kind
    not_null: bool = False
    default: Any = None


@dataclass(frozen=True)
class Unique:
    """Columns whose values no two rows share; nulls never collide. A primary key allows no nulls."""

    columns: tuple[str, ...]
    primary: bool = False
    name: str = ""


@dataclass(frozen=True)
class Check:
    """A predicate in SQL that must not be definitely false."""

    sql: str
    name: str = ""


@dataclass(frozen=True)
class ForeignKey:
    """Columns that, if none is null, must be found in the parent. Actions: "restrict", "cascade", "set null"."""

    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "restrict"
    on_update: str = "restrict"
    name: str = ""


@dataclass(frozen=True)
class Index:
    """Rows are kept sorted by the columns in each file, so that file statistics skip; unique if asked."""

    name: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column_, ...]
    unique: tuple[Unique, ...] = ()
    checks: tuple[Check, ...] = ()
    foreign: tuple[ForeignKey, ...] = ()
    indexes: tuple[Index, ...] = field(default=())

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if len(set(names)) < len(names) or not names:
            raise SchemaError(f"{self.name}: columns must be there, and differ")
        if sum(u.primary for u in self.unique) > 1:
            raise SchemaError(f"{self.name}: one primary key at most")
        used = [c for g in (*self.unique, *self.foreign, *self.indexes) for c in g.columns]
        if missing := set(used) - set(names):
            raise SchemaError(f"{self.name} has no column {', '.join(sorted(missing))}")
        primary = {c for u in self.unique if u.primary for c in u.columns}
        object.__setattr__(self, "columns", tuple(replace(c, not_null=True) if c.name in primary else c for c in self.columns))

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.kind.spark()) for c in self.columns])

    def keys(self) -> list[tuple[str, ...]]:
        """Column sets on which no two rows may agree."""
        return [*(u.columns for u in self.unique), *(i.columns for i in self.indexes if i.unique)]

    def ddl(self) -> str:
        """CREATE TABLE text, for people and other engines."""
        q = lambda names: ", ".join(f'"{n}"' for n in names)
        parts = [f'"{c.name}" {c.kind}' + " NOT NULL" * c.not_null + (f" DEFAULT {sql_text(c.default)}" if c.default is not None else "") for c in self.columns]
        parts += [("PRIMARY KEY" if u.primary else "UNIQUE") + f" ({q(u.columns)})" for u in self.unique]
        parts += [f"CHECK ({c.sql})" for c in self.checks]
        parts += [f'FOREIGN KEY ({q(f.columns)}) REFERENCES "{f.parent}" ({q(f.parent_columns)}) ON DELETE {f.on_delete.upper()} ON UPDATE {f.on_update.upper()}' for f in self.foreign]
        return f'CREATE TABLE "{self.name}" (' + ", ".join(parts) + ");"
