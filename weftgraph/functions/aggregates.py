"""Aggregates of property-graph queries: sums of nothing are 0, lists drop nulls, one value has no deviation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count(x: Column | None = None, distinct: bool = False) -> Column:
    if x is None:
        return F.count(F.lit(1))
    return F.count_distinct(x) if distinct else F.count(x)


def total(x: Column) -> Column:
    """sum, 0 without values."""
    return F.coalesce(F.sum(x), F.lit(0))


def stdev(x: Column) -> Column:
    """Of a sample; 0 for one value or none."""
    return F.when(F.count(x) <= 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def stdevp(x: Column) -> Column:
    return F.coalesce(F.stddev_pop(x), F.lit(0.0))


def percentile_cont(x: str, p: float) -> Column:
    return F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY {x})")


def percentile_disc(x: str, p: float, kind: str = "double") -> Column:
    """The smallest value with at least p of the values up to it, in x's own type."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})").cast(kind)


def collect(x: Column, distinct: bool = False, sort: bool = True) -> Column:
    """A list per group, sorted unless told otherwise. The list is the result: for groups of any size use rows instead."""
    made = F.collect_set(x) if distinct else F.collect_list(x)
    return F.array_sort(made) if sort else made


def collect_ordered(x: Column, by: Column) -> Column:
    """A list per group in the order of by."""
    return F.transform(F.array_sort(F.collect_list(F.struct(by.alias("k"), x.alias("v")))), lambda s: s["v"])
