"""Column expressions shared by several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero (ANSI mode would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def linear(columns: list[Column], weights: list[float], offset: float = 0.0) -> Column:
    """offset + sum(w * x), as one codegen'd expression."""
    return reduce(lambda acc, cw: acc + cw[0] * F.lit(float(cw[1])), zip(columns, weights), F.lit(float(offset)))


def missing_count(columns: list[str]) -> Column:
    """How many of the columns are missing in a row."""
    return total([F.col(c).isNull().cast("int") for c in columns])
