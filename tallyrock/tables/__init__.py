"""Declared tables over Parquet snapshots: types, constraints, DML with cascades, transactions, dumps."""

from .database import Database
from .schema import BIGINT, BLOB, BOOL, DATE, DATETIME, DECIMAL, INT, VARCHAR, Check, Column_, ForeignKey, Index, Table, Unique

__all__ = [n for n in dir() if not n.startswith("_")]
