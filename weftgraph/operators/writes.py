"""Writes as new versions of node and edge DataFrames: nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def create_nodes(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """CREATE: nodes and rows; properties that one side lacks are null."""
    return nodes.unionByName(rows, allowMissingColumns=True)


def merge_nodes(nodes: DataFrame, rows: DataFrame, keys: list[str], on_match: list[str] = (), on_create: dict[str, Column] | None = None) -> DataFrame:
    """MERGE: rows whose keys exist set on_match properties, the others are created (with on_create values).

    Rows that repeat a key in one batch count once (the least by its other values). Null keys never match.
    """
    others = [c for c in rows.columns if c not in keys]
    batch = rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("__new")) if others else rows.distinct().withColumn("__new", F.struct(F.lit(1)))
    updated = nodes.join(batch, keys, "left")
    updated = updated.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(nodes[c]).alias(c) if c in on_match else nodes[c] for c in nodes.columns])
    created = batch.join(nodes.select(*keys).distinct(), keys, "left_anti")
    created = created.select(*keys, *[F.col(f"__new.{c}").alias(c) for c in others])
    for name, value in (on_create or {}).items():
        created = created.withColumn(name, value)
    return updated.unionByName(created, allowMissingColumns=True)


def set_properties(nodes: DataFrame, where: Column, replace: bool = False, key: str | None = None, **values: Column) -> DataFrame:
    """SET n += map for the rows that match; with replace, SET n = map: other properties but the key become null."""
    changes = {k: F.when(where, x).otherwise(nodes[k]) if k in nodes.columns else F.when(where, x) for k, x in values.items()}
    if replace:
        changes |= {c: F.when(~F.coalesce(where, F.lit(False)), nodes[c]) for c in nodes.columns if c != key and c not in values}
    return nodes.withColumns(changes)


def remove_properties(nodes: DataFrame, where: Column, names: list[str]) -> DataFrame:
    """REMOVE n.p: null where the rows match."""
    return nodes.withColumns({c: F.when(~F.coalesce(where, F.lit(False)), nodes[c]) for c in names})


def add_label(labels: Column, label: str) -> Column:
    return F.array_union(labels, F.array(F.lit(label)))


def remove_label(labels: Column, label: str) -> Column:
    return F.array_except(labels, F.array(F.lit(label)))


def delete_nodes(nodes: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """DETACH DELETE, nodes' part; ids has a column id."""
    return nodes.join(ids, nodes[key] == ids["id"], "left_anti")


def detach(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """DETACH DELETE, edges' part: relationships (src, dst) with a deleted end go."""
    gone = ids.select(F.col("id").alias("__id")).distinct()
    kept = edges.join(gone, F.col("src") == F.col("__id"), "left_anti")
    return kept.join(gone, F.col("dst") == F.col("__id"), "left_anti")


def attached(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Relationships that forbid a DELETE without DETACH: those with an end among ids."""
    gone = ids.select(F.col("id").alias("__id")).distinct()
    by_src = edges.join(gone, F.col("src") == F.col("__id"), "left_semi")
    others = edges.join(gone, F.col("src") == F.col("__id"), "left_anti")
    return by_src.unionByName(others.join(gone, F.col("dst") == F.col("__id"), "left_semi"))


def create_edges(edges: DataFrame, pairs: DataFrame, nodes_src: DataFrame, nodes_dst: DataFrame) -> DataFrame:
    """Bulk MATCH (a), (b) CREATE (a)-[]->(b): pairs (src, dst, properties) whose ends exist; the ids are in columns id."""
    met = pairs.join(nodes_src.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    return edges.unionByName(met.join(nodes_dst.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi"), allowMissingColumns=True)


def merge_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """MERGE (a)-[]->(b): pairs that have no relationship yet get one.

    The relationships that pairs meet are found first, so that only the pairs have to be looked up, never all relationships.
    """
    asked = pairs.dropDuplicates(["src", "dst"])
    met = edges.select("src", "dst").join(asked.select("src", "dst"), ["src", "dst"], "left_semi").distinct()
    return edges.unionByName(asked.join(met, ["src", "dst"], "left_anti"), allowMissingColumns=True)


def for_each(rows: DataFrame, values: Column, name: str) -> DataFrame:
    """FOREACH: a row per list element, for one of the writes above."""
    return rows.withColumn(name, F.explode(values))
