"""Errors that the library raises, by kind."""


class EngineError(Exception):
    """Base of all errors of the library."""


class ValueTypeError(EngineError):
    """A value does not fit its column's type."""


class ConstraintError(EngineError):
    """Rows break NOT NULL, CHECK, UNIQUE, PRIMARY KEY or FOREIGN KEY."""


class SchemaError(EngineError):
    """A table, column, index or constraint is missing, doubled or still in use."""


class ExecutionError(EngineError):
    """A query has no meaning in this dialect."""
