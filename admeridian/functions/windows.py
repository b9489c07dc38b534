"""Date windows relative to the data anchor, the largest date of the facts; never the wall clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anchor_of(facts: DataFrame, date: str = "date") -> DataFrame:
    """One row: ``anchor``."""
    return facts.agg(F.max(date).alias("anchor"))


def anchored(facts: DataFrame, date: str = "date") -> DataFrame:
    """``facts`` with their anchor in each row; the side that is crossed in is one row."""
    return facts.crossJoin(F.broadcast(anchor_of(facts, date)))


def since(days: int, date: str = "date") -> Column:
    """State convention: ``days`` + 1 calendar days, the anchor included."""
    return F.col(date) >= F.date_sub(F.col("anchor"), days)


def within(first: int, last: int = 0, date: str = "date") -> Column:
    """Change convention: later than anchor - ``first``, up to anchor - ``last``."""
    return (F.col(date) > F.date_sub(F.col("anchor"), first)) & (F.col(date) <= F.date_sub(F.col("anchor"), last))


def div(a, b) -> Column:
    """a / b, null where b is 0 or null."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(a.cast("double"), b.cast("double"))


def sum_if(condition: Column, value: str | Column) -> Column:
    return F.sum(F.when(condition, F.col(value) if isinstance(value, str) else value))


def max_if(condition: Column, value: str | Column) -> Column:
    return F.max(F.when(condition, F.col(value) if isinstance(value, str) else value))
