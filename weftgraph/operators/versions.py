"""A graph in versions: tables as their first rows with later changes, and writes of whole patterns as one more version.

Nothing is changed in place. A write adds rows that replace those of their key, or tombstones, as a table of its own; reading
joins the keys of later changes away from the rows before them; compacted() writes that as first rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.ordered import numbered
from weftgraph.plans.lineage import materialized


@dataclass(frozen=True)
class Versions:
    """Rows with a key that no two of them share. Version 0 is base; changes has one table for each later version."""

    base: DataFrame
    key: str = "id"
    changes: tuple[DataFrame, ...] = ()

    @property
    def version(self) -> int:
        return len(self.changes)

    def at(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named."""
        changes = self.changes[: self.version if version is None else version]
        if not changes:
            return self.base
        # From the last change back, the rows whose keys no later one has; tables of few changes are not grouped.
        parts, later = [], None
        for c in reversed(changes):
            own = c.where("NOT __gone").drop("__gone")
            parts.append(own if later is None else own.join(later, F.col(self.key) == F.col("__key"), "left_anti"))
            keys = c.select(F.col(self.key).alias("__key"))
            later = keys if later is None else later.unionByName(keys)
        out = self.base.join(later, F.col(self.key) == F.col("__key"), "left_anti")
        for part in reversed(parts):
            out = out.unionByName(part)
        return out

    def _changed(self, rows: DataFrame, gone: bool) -> Versions:
        columns = [rows[c] if c in rows.columns else F.lit(None) for c in self.base.columns]
        typed = rows.select(*[c.cast(self.base.schema[n].dataType).alias(n) for n, c in zip(self.base.columns, columns)], F.lit(gone).alias("__gone"))
        return replace(self, changes=(*self.changes, materialized(typed, "change")))

    def put(self, rows: DataFrame) -> Versions:
        """Another version with these rows, of a key each, in place of those of the same key; columns that they lack are null."""
        return self._changed(rows, False)

    def drop(self, keys: DataFrame) -> Versions:
        """Another version without the rows of these keys."""
        return self._changed(keys.select(self.key).distinct(), True)

    def compacted(self) -> Versions:
        """The last version as the first one of a new table."""
        return Versions(materialized(self.at(), "compact"), self.key)


@dataclass(frozen=True)
class End:
    """A node of a pattern: its label and, for each property that the pattern names, the column of the batch with its value;
    or bound, the batch's column with the id of a node that is there already and is never created."""

    label: str
    keys: Mapping[str, str] = ()
    bound: str = ""


@dataclass(frozen=True)
class Pattern:
    """(a)-[r:type {keys}]->(b)."""

    a: End
    type: str
    b: End
    keys: Mapping[str, str] = ()


@dataclass(frozen=True)
class Graph:
    """nodes: for each label versions of (id, properties); edges: for each type versions of (id, src, dst, properties)."""

    nodes: Mapping[str, Versions]
    edges: Mapping[str, Versions]

    def with_nodes(self, label: str, table: Versions) -> Graph:
        return replace(self, nodes={**self.nodes, label: table})

    def with_edges(self, type_: str, table: Versions) -> Graph:
        return replace(self, edges={**self.edges, type_: table})


def _wanted(rows: DataFrame, p: Pattern) -> tuple[DataFrame, list[str]]:
    """One row for each distinct pattern of a batch (the least by its other columns), and the columns that tell them apart.
    Rows with a null in one of them name no pattern."""
    own = list(dict.fromkeys([*([p.a.bound] if p.a.bound else dict(p.a.keys).values()), *dict(p.keys).values(), *([p.b.bound] if p.b.bound else dict(p.b.keys).values())]))
    others = [c for c in rows.columns if c not in own]
    rows = rows.where(F.lit(True) if not own else ~F.exists(F.array(*[F.col(c).isNull() for c in own]), lambda x: x))
    once = rows.groupBy(*own).agg(F.min(F.struct(*others)).alias("__o")) if others else rows.select(*own).distinct()
    return once.select(*own, *([F.col(f"__o.{c}").alias(c) for c in others])), own


def _end(graph: Graph, end: End, side: str) -> DataFrame:
    nodes = graph.nodes[end.label].at()
    return nodes.select(F.col("id").alias(f"__{side}"), *[F.col(k).alias(f"__{side}_{k}") for k in dict(end.keys)])


def _met(graph: Graph, wanted: DataFrame, p: Pattern) -> DataFrame:
    """wanted with the relationships of the graph that match: r__<column> of each, and __a, __b."""
    edges = graph.edges[p.type].at()
    df = edges.select(*[F.col(c).alias(f"r__{c}") for c in edges.columns])
    on = F.lit(True)
    for end, side, column in ((p.a, "a", "r__src"), (p.b, "b", "r__dst")):
        df = df.join(_end(graph, end, side), F.col(column) == F.col(f"__{side}"))
        on &= F.col(f"__{side}") == F.col(end.bound) if end.bound else F.lit(True)
        for k, c in dict(end.keys).items() if not end.bound else ():
            on &= F.col(f"__{side}_{k}") == F.col(c)
    for k, c in dict(p.keys).items():
        on &= F.col(f"r__{k}") == F.col(c)
    return wanted.join(df, on).drop(*[c for c in df.columns if c.startswith(("__a_", "__b_"))])


def _next_id(table: Versions) -> int:
    """After the largest id of all versions, so that none is used again."""
    ids = [t.agg(F.max(table.key)).first()[0] for t in (table.base, *table.changes)]
    return 1 + max([int(i) for i in ids if i is not None], default=-1)


def _created(graph: Graph, rows: DataFrame, p: Pattern, order: list[str], values: Mapping[str, Column]) -> Graph:
    """A relationship for each row, with new nodes where an end is not bound. New ids follow the largest, gapless, in order."""
    # The numbered rows lie in a table already; each write reads them from there.
    new = numbered(rows, order, "__n")
    ends = {}
    for end, side in ((p.a, "a"), (p.b, "b")):
        table = graph.nodes[end.label]
        # Where both ends have one label, the second one's ids follow those that the first has just got.
        ends[side] = F.col(end.bound) if end.bound else F.col("__n") + _next_id(table)
        if not end.bound:
            made = {k: F.col(c) for k, c in dict(end.keys).items()} | {k.partition(".")[2]: x for k, x in values.items() if k.startswith(f"{side}.")}
            graph = graph.with_nodes(end.label, table.put(new.select(ends[side].alias("id"), *[x.alias(k) for k, x in made.items()])))
    made = {k: F.col(c) for k, c in dict(p.keys).items()} | {k.partition(".")[2]: x for k, x in values.items() if k.startswith("r.")}
    edges = graph.edges[p.type]
    rows = new.select((F.col("__n") + _next_id(edges)).alias("id"), ends["a"].alias("src"), ends["b"].alias("dst"), *[x.alias(k) for k, x in made.items()])
    return graph.with_edges(p.type, edges.put(rows))


def create(graph: Graph, rows: DataFrame, p: Pattern, values: Mapping[str, Column] = {}) -> Graph:
    """CREATE (a)-[r]->(b) for each row of the batch, repeated or not; bound ends are used as they are.

    values: "a.<property>", "r.<property>" or "b.<property>" to an expression over the batch.
    """
    return _created(graph, rows, p, rows.columns, values)


def merge(graph: Graph, rows: DataFrame, p: Pattern, on_create: Mapping[str, Column] = {}, on_match: Mapping[str, Column] = {}) -> Graph:
    """MERGE (a)-[r]->(b): for each distinct pattern of the batch, all relationships that match it, or else a whole new one.

    As in the query language a pattern matches as a whole: where the relationship is missing, ends that are not bound are
    created with it, even if nodes with their properties exist. on_create and on_match map "a.x", "r.x" or "b.x" (on_match:
    "r.x" only) to expressions over the batch, on_match also over r__<property> as it was. Rows that repeat a pattern count
    once, the least by their other columns; rows with a null property match and create nothing.
    """
    if bad := [k for k in on_match if not k.startswith("r.")]:
        raise ValueError(f"{bad}: a match sets properties of the relationship")
    wanted, own = _wanted(rows, p)
    wanted = materialized(wanted, "wanted")
    met = materialized(_met(graph, wanted, p), "met")
    missing = wanted.join(met.select(*own).distinct(), own, "left_anti")
    if on_match:
        edges = graph.edges[p.type]
        sets = {k.partition(".")[2]: x for k, x in on_match.items()}
        changed = met.select(*[sets.get(c, F.col(f"r__{c}")).alias(c) for c in edges.base.columns]).dropDuplicates(["id"])
        graph = graph.with_edges(p.type, edges.put(changed))
    return _created(graph, missing, p, own, on_create)


def delete_edges(graph: Graph, type_: str, ids: DataFrame) -> Graph:
    """DELETE r: ids has a column id."""
    return graph.with_edges(type_, graph.edges[type_].drop(ids))


def detach_delete(graph: Graph, label: str, ids: DataFrame, ends: Mapping[str, tuple[str, str]]) -> Graph:
    """DETACH DELETE of nodes; ends maps each type to the labels of its source and target."""
    gone = materialized(ids.select(F.col("id").alias("__id")).distinct(), "gone")
    for type_, labels in ends.items():
        for column, end in zip(("src", "dst"), labels):
            if end == label:
                rows = graph.edges[type_].at()
                graph = graph.with_edges(type_, graph.edges[type_].drop(rows.join(gone, F.col(column) == F.col("__id"), "left_semi")))
    return graph.with_nodes(label, graph.nodes[label].drop(gone.withColumnRenamed("__id", "id")))
