"""Connected components by union-find inside partitions and min-label hooking between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import written


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links: each node but the roots, with the smallest node it reaches here."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["child", "parent"])


def components(links: DataFrame) -> DataFrame:
    """(child, parent) for links of two long columns: every node that is not the smallest of its component, with that one.

    Each partition first shrinks its links to a forest; then every node hooks to its smallest neighbour and follows it,
    with mins that are aggregated before the shuffle, so that a node of very high degree is no hot spot. Links and
    labels never reach the driver, only the number of unsettled nodes of a round does. No links give no rows.
    """
    edges = written(links.toDF("child", "parent").mapInArrow(_local_forest, "child long, parent long"), "forest")
    while True:
        least = written(edges.groupBy("child").agg(F.min("parent").alias("least"), F.max("parent").alias("most")), "least")
        above = least.select(F.col("child").alias("parent"), F.col("least").alias("up"))
        # Settled when every node has one parent and no parent has a parent.
        open_ones = least.where("least != most").select("child").unionByName(least.join(above, F.col("least") == F.col("parent"), "left_semi").select("child"))
        if open_ones.isEmpty():
            return least.select("child", F.col("least").alias("parent"))
        hooked = edges.join(least.select("child", "least"), "child")
        hooked = hooked.select("child", F.col("least").alias("parent")).unionByName(
            hooked.where("parent != least").select(F.col("parent").alias("child"), F.col("least").alias("parent"))
        )
        followed = hooked.join(above, "parent", "left").select("child", "parent", "up")
        merged = followed.select("child", F.coalesce(F.least("up", "parent"), "parent").alias("parent")).unionByName(
            followed.where("up IS NOT NULL").select(F.col("parent").alias("child"), F.col("up").alias("parent"))
        )
        merged = merged.where("child != parent").select(F.greatest("child", "parent").alias("child"), F.least("child", "parent").alias("parent"))
        edges = written(merged.distinct(), "edges")
