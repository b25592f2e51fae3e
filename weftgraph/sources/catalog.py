"""Tables as a property graph: labels are tables with an id, relationship types are tables or foreign keys."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.ordered import numbered
from weftgraph.plans.lineage import materialized

#: A table, or what makes it when a query first needs it, so that a large catalog opens only the tables in use.
Table = DataFrame | Callable[[], DataFrame]


@dataclass(frozen=True)
class NodeTable:
    label: str
    table: Table
    key: str
    labels: tuple[str, ...] = ()

    @cached_property
    def df(self) -> DataFrame:
        df = self.table if isinstance(self.table, DataFrame) else self.table()
        if self.key not in df.columns or "id" in df.columns and self.key != "id":
            raise KeyError(f"{self.label} has no column {self.key}, or a column id beside it")
        return df

    @property
    def properties(self) -> list[str]:
        return self.df.columns


@dataclass(frozen=True)
class EdgeTable:
    """on: None for a table of its own; "source" or "target" if src and dst are columns of that end's table (a foreign
    key), so that a hop to or from that end needs no edge table. key: the columns that tell relationships apart (a foreign
    key's row is told apart by its node's key); by_place: rows of Parquet files are told apart by their place in them.
    With neither, all columns tell them apart, and equal rows are one relationship."""

    type: str
    table: Table
    source: str
    target: str
    src: str
    dst: str
    on: str | None = None
    key: tuple[str, ...] = ()
    by_place: bool = False

    @property
    def identity(self) -> list[str]:
        return [self.src if self.on == "source" else self.dst] if self.on else list(self.key) or self.df.columns

    @cached_property
    def df(self) -> DataFrame:
        return self.table if isinstance(self.table, DataFrame) else self.table()

    @property
    def properties(self) -> list[str]:
        return [] if self.on else [c for c in self.df.columns if c not in (self.src, self.dst)]


@dataclass
class GraphCatalog:
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    edges: dict[str, EdgeTable] = field(default_factory=dict)
    dictionaries: dict[str, DataFrame] = field(default_factory=dict)

    def add_nodes(self, label: str, df: Table, key: str, labels: tuple[str, ...] = ()) -> GraphCatalog:
        """labels: further labels of the same rows. A column named id can only be the key."""
        self.nodes[label] = NodeTable(label, df, key, labels)
        return self

    def add_edges(self, type_: str, df: Table, source: str, target: str, src: str, dst: str, key: tuple[str, ...] = (), by_place: bool = False) -> GraphCatalog:
        """key: columns that tell relationships apart. by_place: each row of a table of Parquet files is a relationship,
        equal or not. With neither, equal rows are one, which takes a shuffle at each use."""
        for end in (source, target):
            self.node(end)
        self.edges[type_] = EdgeTable(type_, df, source, target, src, dst, key=tuple(key), by_place=by_place)
        return self

    def add_keyed_nodes(self, label: str, df: DataFrame, key: tuple[str, ...], labels: tuple[str, ...] = ()) -> GraphCatalog:
        """Nodes whose key is of any type, or of several columns. They get dense longs as ids, in the order of their keys,
        from a dictionary that is written once; rows with a null in the key have no id and are no nodes, and the key has
        to be unique. Their columns stay properties, so none may be named id."""
        if "id" in {c.lower() for c in df.columns}:
            raise KeyError(f"{label} has a column id beside its key")
        ids = dense_ids(df, list(key))
        self.dictionaries[label] = ids
        return self.add_nodes(label, coded(df, ids, list(key), "id").where("id IS NOT NULL"), "id", labels)

    def add_keyed_edges(self, type_: str, df: DataFrame, source: str, target: str, src: tuple[str, ...], dst: tuple[str, ...], key: tuple[str, ...] = ()) -> GraphCatalog:
        """Relationships whose ends are named by the keys of add_keyed_nodes, or by one column with the id of other nodes.
        Those with an unknown end are none. key: columns that tell them apart (all columns, if none are named)."""
        for column, label, own in (("__src", source, src), ("__dst", target, dst)):
            df = coded(df, self.dictionaries[label], list(own), column) if label in self.dictionaries else df.withColumn(column, F.col(own[0]).cast("long"))
        return self.add_edges(type_, df, source, target, "__src", "__dst", key=tuple(key))

    def add_foreign_key(self, type_: str, source: str, target: str, column: str, on: str) -> GraphCatalog:
        """The column of the source's (or target's) table that holds the other end's key."""
        own = self.node(source if on == "source" else target)
        pair = (own.key, column) if on == "source" else (column, own.key)
        self.edges[type_] = EdgeTable(type_, lambda: own.df, source, target, *pair, on)
        return self

    def node(self, label: str) -> NodeTable:
        if label not in self.nodes:
            raise KeyError(f"unknown label {label}{_hint(label, self.nodes)}")
        return self.nodes[label]

    def edge(self, type_: str) -> EdgeTable:
        if type_ not in self.edges:
            raise KeyError(f"unknown relationship type {type_}{_hint(type_, self.edges)}")
        return self.edges[type_]

    def edge_rows(self, type_: str) -> DataFrame:
        """(src, dst, eid) and the properties of a type; rows without either end are no relationship."""
        e = self.edge(type_)
        df = e.df if e.on or e.key or e.by_place else e.df.distinct()
        own = [F.col(c).cast("long") if e.on else F.col(c) for c in e.identity]
        if e.by_place:
            place = df.metadataColumn("_metadata")
            own = [place["file_path"], place["row_index"]]
        columns = [F.col(e.src).cast("long").alias("src"), F.col(e.dst).cast("long").alias("dst"), F.xxhash64(F.lit(type_), *own).alias("eid")]
        return df.select(*columns, *e.properties).where("src IS NOT NULL AND dst IS NOT NULL")

    def tables_of(self, *labels: str) -> list[NodeTable]:
        """The tables whose rows have all of these labels, their own or further ones."""
        found = [n for _, n in sorted(self.nodes.items()) if set(labels) <= {n.label, *n.labels}]
        if not found:
            raise KeyError(f"no node has the labels {':'.join(labels)}{_hint(labels[0], self.nodes)}")
        return found

    def all_nodes(self, properties: bool = False) -> DataFrame:
        """(label, id) of every node, with properties also (labels, properties), the latter as a JSON text."""
        parts = []
        for _, n in sorted(self.nodes.items()):
            more = [F.array(*map(F.lit, (n.label, *n.labels))).alias("labels"), F.to_json(F.struct(*n.properties)).alias("properties")] if properties else []
            parts.append(n.df.select(F.lit(n.label).alias("label"), F.col(n.key).cast("long").alias("id"), *more))
        return _union(parts)

    def fetch(self, most_nodes: int, most_edges: int) -> tuple[DataFrame, DataFrame]:
        """Up to so many nodes (label, id, labels, properties) and relationships (type, src, dst, properties), by name and id."""
        edges = [self.edge_rows(t).select(F.lit(t).alias("type"), "src", "dst", F.to_json(F.struct(*e.properties) if e.properties else F.struct()).alias("properties")) for t, e in sorted(self.edges.items())]
        return self.all_nodes(True).orderBy("label", "id").limit(most_nodes), _union(edges).orderBy("type", "src", "dst", "properties").limit(most_edges)

    def all_edges(self) -> DataFrame:
        """(type, src, dst) of every relationship."""
        return _union([self.edge_rows(t).select(F.lit(t).alias("type"), "src", "dst") for t in sorted(self.edges)])

    def to_dict(self) -> dict:
        nodes = {k: sorted(n.properties) for k, n in sorted(self.nodes.items())}
        return {"nodes": nodes, "relationships": {k: [e.source, e.target, sorted(e.properties)] for k, e in sorted(self.edges.items())}}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    def describe(self, spark: SparkSession) -> DataFrame:
        """(kind, name, source, target, property, type): one row per property, one with null for a type without any."""
        rows = [("node", k, None, None, f.name, f.dataType.simpleString()) for k, n in self.nodes.items() for f in n.df.schema]
        for k, e in self.edges.items():
            rows += [("relationship", k, e.source, e.target, p, e.df.schema[p].dataType.simpleString()) for p in e.properties or []]
            rows += [] if e.properties else [("relationship", k, e.source, e.target, None, None)]
        return spark.createDataFrame(rows, "kind string, name string, source string, target string, property string, type string")

    def counts(self) -> DataFrame:
        """(kind, name, n) of every label and type."""
        nodes = self.all_nodes().groupBy("label").count().select(F.lit("node").alias("kind"), F.col("label").alias("name"), F.col("count").alias("n"))
        edges = self.all_edges().groupBy("type").count().select(F.lit("relationship").alias("kind"), F.col("type").alias("name"), F.col("count").alias("n"))
        return nodes.unionByName(edges)


def dense_ids(df: DataFrame, key: list[str]) -> DataFrame:
    """A dictionary (__k0, __k1, ..., __id): each distinct key without nulls and a gapless long from 0, in key order."""
    names = [f"__k{i}" for i in range(len(key))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(key, names)]).dropna().distinct()
    return materialized(numbered(rows, names, "__id"), "dictionary")


def coded(df: DataFrame, ids: DataFrame, key: list[str], name: str) -> DataFrame:
    """df with the id of its key from dense_ids(), null for a key that is not there."""
    met = F.lit(True)
    for i, k in enumerate(key):
        met &= F.col(k) == F.col(f"__k{i}")
    return df.join(ids, met, "left").select(*df.columns, F.col("__id").alias(name))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _hint(name: str, known: dict) -> str:
    import difflib

    near = difflib.get_close_matches(name.lower(), {k.lower(): k for k in known}, 1)
    return f", did you mean {next(k for k in known if k.lower() == near[0])}?" if near else ""
