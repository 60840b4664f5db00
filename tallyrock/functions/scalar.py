"""UPPER, LOWER, LENGTH, ABS, CONCAT, COALESCE, the clock, and arithmetic. A null operand gives null."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def upper_of(text: Column) -> Column:
    """a-z to capitals; other letters stay."""
    return F.translate(text, _LOWER, _UPPER)


def lower_of(text: Column) -> Column:
    """A-Z to small letters; other letters stay."""
    return F.translate(text, _UPPER, _LOWER)


def length_of(text: Column) -> Column:
    """Bytes of the UTF-8 form."""
    return F.octet_length(text)


def abs_of(number: Column) -> Column:
    return F.abs(number)


def concat_of(*parts: Column, flags: tuple[int, ...] = ()) -> Column:
    """All parts end to end, null if any is. Parts at ``flags`` are booleans: true is '1', false ''."""
    return F.concat(*(F.when(p, "1").when(~p, "") if k in flags else p.cast("string") for k, p in enumerate(parts)))


def coalesce_of(*parts: Column) -> Column:
    """The first part that is not null; null without parts."""
    return F.coalesce(*parts) if parts else F.lit(None)


def divide(a: Column, b: Column) -> Column:
    """True division; under ANSI a zero divisor is an error."""
    return a.cast("double") / b.cast("double")


def modulo(a: Column, b: Column) -> Column:
    """Of both operands cut to whole numbers; the sign is the dividend's."""
    return a.cast("long") % b.cast("long")


def negate(a: Column) -> Column:
    return -a


def clock(now: datetime | None = None) -> tuple[Column, Column]:
    """CURRENT_TIMESTAMP and CURRENT_DATE of one statement: the same instant in all rows and tasks."""
    moment = (now or datetime.now(UTC)).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz"), F.lit(moment.date())
