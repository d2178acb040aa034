"""Null-dialect helpers: SQL three-valued logic, SAS missing values, safe division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def safe_div(num, den) -> Column:
    """num / den, null when den is null or 0 (never raises under ANSI mode)."""
    num, den = _c(num), _c(den)
    return F.when(den.isNull() | (den == 0), F.lit(None).cast("double")).otherwise(
        num.cast("double") / den.cast("double"))


def blank(c) -> Column:
    """True when a string is null or only spaces."""
    c = _c(c)
    return c.isNull() | (F.trim(c) == "")


def flag(pred: Column) -> Column:
    """0/1 integer from a predicate; a null predicate gives 0."""
    return F.when(pred, F.lit(1)).otherwise(F.lit(0)).cast("int")


def sas_lt(c, value) -> Column:
    """SAS comparison: a missing number is smaller than every number."""
    c = _c(c)
    return c.isNull() | (c < value)


def sas_ge(c, value) -> Column:
    c = _c(c)
    return c.isNotNull() & (c >= value)


def null_safe_ne(c, value) -> Column:
    """SAS ``^=``: true for a missing value (SQL ``<>`` would give null)."""
    return ~(_c(c).eqNullSafe(F.lit(value)))
