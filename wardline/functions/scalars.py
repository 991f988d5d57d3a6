"""Scalar expressions with strict null rules; every one stays inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as a written number.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z"


def safe_float(text: Column) -> Column:
    """The number that a text writes, else null; blanks around it do not matter, NaN is null, infinities are kept."""
    bare = F.regexp_replace(text, r"^\s+|\s+\z", "")
    low = F.lower(bare)
    sign = F.when(low.startswith("-"), -1.0).otherwise(1.0)
    infinite = low.rlike(r"^[+-]?(inf|infinity)\z")
    return F.when(bare.rlike(NUMBER), bare.try_cast("double")).when(infinite, sign * F.lit(float("inf")))


def no_nan(value: Column) -> Column:
    """NaN as null."""
    return F.nanvl(value, F.lit(None).cast("double"))


def between(value: Column, low: float | Column, high: float | Column) -> Column:
    """Clipped into [low, high]; null stays null."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def sigmoid(value: Column, bound: float) -> Column:
    """1 / (1 + exp(-x)), x clipped to +-bound first."""
    return 1 / (1 + F.exp(-between(value, -bound, bound)))


def signed_log1p(value: Column) -> Column:
    return F.signum(value) * F.log1p(F.abs(value))


def zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0; an unknown one does not hold."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(a, b)
