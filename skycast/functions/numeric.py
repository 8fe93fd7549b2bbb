"""Null-keeping bounds: SQL's greatest and least skip nulls, these do not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least(c: Column, low) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, low if isinstance(low, Column) else F.lit(float(low))))


def at_most(c: Column, high) -> Column:
    return F.when(c.isNotNull(), F.least(c, high if isinstance(high, Column) else F.lit(float(high))))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(c, F.lit(float(high)))))
