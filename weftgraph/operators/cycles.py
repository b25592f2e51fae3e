"""Triangles of a graph without its open wedges.

Each edge leads from its end with fewer neighbours to that with more. Then no node leads to more than the root of twice the
number of edges, however many neighbours it has, and the third corners of an edge are what the short lists of both its ends
have in common. Where the order of ids keeps to that bound too, it takes the place of the neighbours' number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.lineage import materialized


def oriented(edges: DataFrame) -> DataFrame:
    """(u, v, rank): the distinct edges (src, dst) without direction and self-loops, from fewer neighbours to more, ties by id, or
    from smaller ids to larger where no id leads to more others than the root of twice the number of edges. They go up in (rank of v, v)."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    pairs = materialized(edges.where("src != dst").select(low.alias("a"), high.alias("b")).distinct(), "pairs")
    most, every = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if most is None or most * most <= 2 * every:
        return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(0).cast("long").alias("rank"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    ranked = pairs.join(degree.toDF("a", "__na"), "a").join(degree.toDF("b", "__nb"), "b")
    first = F.struct("__na", "a") <= F.struct("__nb", "b")
    return materialized(ranked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"), F.greatest("__na", "__nb").alias("rank")), "oriented")


def _met(edges: DataFrame) -> DataFrame:
    """(u, v, ws): each edge with the nodes that both its ends lead to, where there are any."""
    ahead = oriented(edges).groupBy("u").agg(F.sort_array(F.collect_list(F.struct("rank", "v"))).alias("vs"))
    ahead = materialized(ahead.select("u", F.col("vs.v").alias("vs")), "ahead")
    # What v leads to comes after v.
    rows = ahead.where(F.size("vs") > 1).select("u", F.posexplode("vs").alias("at", "v"), "vs").where(F.col("at") + 1 < F.size("vs"))
    rows = rows.select("u", "v", F.slice("vs", F.col("at") + 2, F.size("vs")).alias("__us"))
    return rows.join(ahead.toDF("v", "__vs"), "v").select("u", "v", F.array_intersect("__us", "__vs").alias("ws")).where(F.size("ws") > 0)


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c: the triples of nodes that are all joined by edges (src, dst), whatever their directions and
    number. Null ends and self-loops make none."""
    found = _met(edges).select("u", "v", F.explode("ws").alias("w")).select(F.array_sort(F.array("u", "v", "w")).alias("t"))
    return found.select(*[F.get("t", F.lit(i)).alias(n) for i, n in enumerate("abc")])


def triangle_counts(edges: DataFrame) -> DataFrame:
    """(node, n): in how many triangles a node is, for the nodes that are in one. An edge gives its ends all of its triangles
    at once."""
    met = _met(edges).select(F.size("ws").cast("long").alias("all"), F.posexplode(F.concat(F.array("u", "v"), "ws")).alias("at", "node"))
    return met.select("node", F.when(F.col("at") < 2, F.col("all")).otherwise(1).alias("n")).groupBy("node").agg(F.sum("n").alias("n"))
