"""Running extremes and sums, bounds, orders and positions over array columns.

Positions count from 0. Nulls in an array make sums null from there on and are passed over by extremes; an empty array
gives an empty array, or null where a single value is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _upto(values: Column, fold) -> Column:
    return F.transform(values, lambda _, i: fold(F.slice(values, F.lit(1), i + 1)))


def cumsum(values: Column) -> Column:
    return _upto(values, lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double")))


def cummin(values: Column) -> Column:
    return _upto(values, F.array_min)


def cummax(values: Column) -> Column:
    return _upto(values, F.array_max)


def pmin(bound: float, values: Column) -> Column:
    """Each value, but bound at most."""
    return F.transform(values, lambda x: F.least(F.lit(bound), x.cast("double")))


def pmax(bound: float, values: Column) -> Column:
    """Each value, but bound at least."""
    return F.transform(values, lambda x: F.greatest(F.lit(bound), x.cast("double")))


def order(values: Column, decreasing: bool = False) -> Column:
    """Positions in order of value; equal values keep their order."""
    keyed = F.transform(values, lambda x, i: F.struct((-x if decreasing else x).alias("x"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda e: e["i"])


def ordered(values: Column, positions: Column) -> Column:
    """The values at the given positions."""
    return F.transform(positions, lambda i: F.get(values, i))


def min_index(values: Column) -> Column:
    """Position of the first smallest value."""
    return F.get(order(values), F.lit(0))


def max_index(values: Column) -> Column:
    """Position of the first largest value."""
    return F.get(order(values, decreasing=True), F.lit(0))


def _finite(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def finite_min(values: Column) -> Column:
    """The smallest value that is finite."""
    return F.array_min(_finite(values))


def finite_max(values: Column) -> Column:
    """The largest value that is finite."""
    return F.array_max(_finite(values))
