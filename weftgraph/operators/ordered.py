"""Neighbours and ranks in an order, for groups of any size.

Rows are dealt by range over (group, order) and written with their place, so that a group with a large share of the rows
lies in many even partitions. What crosses partitions comes from a table with a row for each partition and group in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.plans.lineage import materialized


def in_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """df sorted by columns (ascending, nulls first) over all partitions, as a written table with part and pos, the row's
    place in its partition."""
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return materialized(ranged.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")


def following(df: DataFrame, group: str, order: list[str], key: str) -> DataFrame:
    """(key, next): each row's successor of the same group in the order; the last of a group has none.

    Rows that tie in all of order and key follow one another in any order. A null group is a group.
    """
    placed = in_order(df.select(group, *order, key), [group, *order, key])
    here = Window.partitionBy("part").orderBy("pos")
    after = placed.select("part", F.col(group).alias("__g"), key, F.lead(F.struct(F.col(group).alias("g"), F.col(key).alias("k"))).over(here).alias("__next"))
    # One row for each partition that has rows: the first row of the next one.
    heads = placed.where("pos = 0").select("part", F.struct(F.col(group).alias("g"), F.col(key).alias("k")).alias("__head"))
    heads = heads.select("part", F.lead("__head").over(Window.orderBy("part")).alias("__head"))
    met = after.join(heads, "part").withColumn("__next", F.coalesce("__next", "__head"))
    return met.where(F.col("__next").isNotNull() & F.col("__g").eqNullSafe(F.col("__next.g"))).select(key, F.col("__next.k").alias("next"))


def percentiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float], discrete: bool = False) -> DataFrame:
    """groups and, for each name in shares, that percentile of the values of a group that are not null.

    Continuous ones are interpolated doubles, discrete ones the smallest value with at least that share of the values up to
    it. Groups without a value give no row; null is a group; without groups there is one row, of nulls if there is no value. Ranks come from where
    groups lie in an order over all rows, so no task holds a group or the distinct values of one.
    """
    if any(not 0 <= p <= 1 for p in shares.values()):
        raise ValueError("percentiles are between 0 and 1")
    rows = in_order(df.where(F.col(value).isNotNull()).select(*groups, value), [*groups, value])
    at = rows.groupBy(*groups, "part").agg(F.min("pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # A row for each partition and group in it, so at most as many as both together.
    before = Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__all": F.sum("__n").over(Window.partitionBy(*groups))})

    def ranks(name: str, p: float) -> list[Column]:
        """The ranks from 0 that a percentile needs, with their weights."""
        if discrete:
            return [F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.col("__all") * p) - 1, F.lit(0)).cast("long").alias("rank"), F.lit(1.0).alias("weight"))]
        exact = (F.col("__all") - 1) * F.lit(float(p))
        low, share = F.floor(exact).cast("long"), exact - F.floor(exact)
        return [F.struct(F.lit(name).alias("name"), low.alias("rank"), (1 - share).alias("weight")), F.struct(F.lit(name).alias("name"), (low + 1).alias("rank"), share.alias("weight"))]

    wanted = at.select(*groups, "part", "__first", "__n", "__before", F.explode(F.array(*[r for name, p in shares.items() for r in ranks(name, p)])).alias("__r"))
    place = F.col("__r.rank") - F.col("__before")
    wanted = wanted.where((F.col("__r.weight") > 0) & (place >= 0) & (place < F.col("__n"))).select(F.col("part").alias("__part"), (F.col("__first") + place).alias("__pos"), "__r")
    found = rows.join(wanted, (F.col("part") == F.col("__part")) & (F.col("pos") == F.col("__pos")))
    made = F.max if discrete else lambda c: F.sum(c.cast("double") * F.col("__r.weight"))
    return found.groupBy(*groups).agg(*[made(F.when(F.col("__r.name") == name, F.col(value))).alias(name) for name in shares])


def numbered(df: DataFrame, order: list[str], name: str, first: Column | int = 0) -> DataFrame:
    """df with a gapless number from `first` on, in this order over all rows; ties in any order.

    A row's number is its place in its partition and the rows of the partitions before, a prefix sum with a row for each.
    """
    placed = in_order(df, order)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("__n")).select("part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    first = F.lit(first) if isinstance(first, int) else first
    return placed.join(starts, "part").select(*df.columns, (F.col("__start") + F.col("pos") + first).cast("long").alias(name))
