"""Procedure calls: CALL name(args) YIELD column AS variable, as functions that return tables."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.vector_index import VectorIndex
from weftgraph.sources.catalog import GraphCatalog


@dataclass(frozen=True)
class Procedure:
    """make(graph, *args) gives a table with the columns that can be yielded."""

    name: str
    yields: tuple[str, ...]
    make: Callable[..., DataFrame]


_KNOWN: dict[str, Procedure] = {}


def register(name: str, *yields: str) -> Callable:
    """Makes a function (graph, *args) -> DataFrame with these columns a procedure; a name is given once."""

    def put(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _KNOWN:
            raise ValueError(f"there is a procedure {name} already")
        _KNOWN[name] = Procedure(name, yields, make)
        return make

    return put


def procedures() -> dict[str, tuple[str, ...]]:
    """Name -> what it yields."""
    return {n: p.yields for n, p in sorted(_KNOWN.items())}


def call_procedure(graph: GraphCatalog, name: str, /, *args, **yields: str) -> DataFrame:
    """CALL name(args) YIELD column AS variable: yields maps variables to columns; without any, all columns are yielded."""
    if name not in _KNOWN:
        near = difflib.get_close_matches(name, _KNOWN, 1)
        raise KeyError(f"unknown procedure {name}" + (f", did you mean {near[0]}?" if near else ""))
    known = _KNOWN[name]
    if bad := sorted(set(yields.values()) - set(known.yields)):
        raise KeyError(f"{name} does not yield {bad}, but {list(known.yields)}")
    wanted = yields or {y: y for y in known.yields}
    return known.make(graph, *args).select(*[F.col(column).alias(variable) for variable, column in wanted.items()])


@register("db.labels", "label", "n")
def _labels(graph: GraphCatalog) -> DataFrame:
    """Every label that a node has, further ones too, and the number of its nodes."""
    return graph.all_nodes(properties=True).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("db.relationshipTypes", "relationshipType", "n")
def _types(graph: GraphCatalog) -> DataFrame:
    return graph.all_edges().groupBy(F.col("type").alias("relationshipType")).agg(F.count(F.lit(1)).alias("n"))


@register("db.propertyKeys", "propertyKey", "label", "n")
def _keys(graph: GraphCatalog) -> DataFrame:
    """Every property of nodes and how many nodes of a label have it."""
    out = None
    for label, node in sorted(graph.nodes.items()):
        counts = node.df.agg(*[F.count(F.col(c)).alias(c) for c in node.properties]).unpivot([], node.properties, "propertyKey", "n")
        part = counts.select("propertyKey", F.lit(label).alias("label"), "n")
        out = part if out is None else out.unionByName(part)
    return out.where("n > 0")


@register("db.index.vector.queryNodes", "query", "node", "score", "rank")
def _vectors(graph: GraphCatalog, index: VectorIndex, k: int, queries: DataFrame) -> DataFrame:
    """The k nodes nearest to each of the queries (query, vector), by an index."""
    return index.search(queries, k).withColumnRenamed(index.key, "node")
