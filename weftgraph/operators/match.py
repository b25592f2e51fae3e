"""Graph patterns as joins: a Match is a DataFrame of bindings that grows hop by hop.

A bound node `c` has the columns `c__id` and `c__<property>`, a bound relationship `r` has `r__eid` and its properties.
Everything stays an ordinary DataFrame plan: filters and unused properties reach the scans, joins are Catalyst's to order.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.paths import var_length
from weftgraph.sources.catalog import EdgeTable, GraphCatalog


def v(name: str) -> Column:
    """The column of `var.property`, `var.id` or a plain name."""
    return F.col(name.replace(".", "__"))


#: Numbers of relationships without a name, so that no two in a process share one.
_unnamed = itertools.count()


@dataclass(frozen=True)
class Used:
    """A relationship that a pattern has bound: its type(s), the column of its identity, and whether that is a list (a path)
    or, for a foreign key, the id of the node whose row holds it."""

    types: frozenset[str]
    column: str
    kind: str = "edge"

    def eid(self) -> Column:
        return F.xxhash64(F.lit(next(iter(self.types))), F.col(self.column)) if self.kind == "key" else F.col(self.column)

    def apart(self, other: Used) -> Column | None:
        """The condition that two relationships differ; None where their types do."""
        if not self.types & other.types:
            return None
        if self.kind == other.kind == "key":
            return F.col(self.column) != F.col(other.column)
        if self.kind == other.kind == "path":
            return ~F.arrays_overlap(self.column, other.column)
        if "path" in (self.kind, other.kind):
            path, one = (self, other) if self.kind == "path" else (other, self)
            return ~F.array_contains(F.col(path.column), one.eid())
        return self.eid() != other.eid()


class Unbound(Exception):
    """A sub-pattern mentions a variable of the rows around it that it has not imported yet."""

    def __init__(self, name: str) -> None:
        super().__init__(f"{name} is not bound here")
        self.name = name


def _variable(column: str) -> str:
    """The variable of a column, or the column itself where it is an item of WITH."""
    return column.partition("__")[0] if "__" in column.lstrip("_") else column


class Match:
    """Rows of bound variables. Methods return a new Match; df is the bindings' DataFrame.

    The relationships of one MATCH differ from one another, over foreign keys and comma parts as well. clause(), with_(),
    group(), call() and optional() begin another MATCH, whose relationships may be those of an earlier one.

    Sub-patterns (exists, count_of, aggregate, optional, call) see the variables around them: a hop to or from one, or a
    condition on its properties, holds for the outer row's. Such a pattern grows from the distinct values of the variables
    that it mentions, and is joined back on all of their identities.
    """

    def __init__(self, graph: GraphCatalog, df: DataFrame | None, labels: dict[str, str], used: tuple[Used, ...] = (), outer: frozenset[str] = frozenset(), differ: bool = True, narrow: bool = False, within: DataFrame | None = None, types: dict[str, str] | None = None) -> None:
        """types: of named relationships of one type. outer: variables that a sub-pattern could import. differ: no two rows are equal in all identities. narrow: a
        condition has been set. A sub-pattern that has not begun has no df; within then has the ids that it is needed for."""
        self.graph, self._df, self.labels, self.used = graph, df, labels, used
        self.outer, self.differ, self.narrow, self.within, self.types = outer, differ, narrow, within, types or {}

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            raise Unbound(next(iter(self.labels)))
        return self._df

    def _with(self, df: DataFrame, labels: dict[str, str] | None = None, used: tuple[Used, ...] | None = None, differ: bool | None = None) -> Match:
        return Match(self.graph, df, self.labels if labels is None else labels, self.used if used is None else used, self.outer, self.differ if differ is None else differ, True, self.within, self.types)

    def _using(self, df: DataFrame, labels: dict[str, str], new: Used) -> Match:
        """df with a further relationship, which is none of those before."""
        for other in self.used:
            if (condition := new.apart(other)) is not None:
                df = df.where(condition)
        out = self._with(df, labels, (*self.used, new))
        if new.kind == "edge" and len(new.types) == 1:
            out.types = self.types | {_variable(new.column): next(iter(new.types))}
        return out

    def _bound(self, name: str) -> bool:
        """Whether a variable has a value; a sub-pattern imports those that have one around it."""
        if name not in self.labels and name in self.outer:
            raise Unbound(name)
        return name in self.labels

    def _resolved(self, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """make(df), or Unbound for a column that can be imported."""
        try:
            return make(self.df)
        except AnalysisException as e:
            if (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
                name = _variable((e.getMessageParameters() or {}).get("objectName", "").strip("`"))
                if name in self.outer and name not in {_variable(c) for c in self.df.columns}:
                    raise Unbound(name) from None
            raise

    def _at(self, var: str, labels: tuple[str, ...], what: str) -> Match:
        """This, with only the rows whose var is a node of one of these labels' tables."""
        if not self._bound(var):
            raise KeyError(f"{var} is not bound")
        own = self.labels[var]
        if own in labels:
            return self
        met = [x for x in labels if x in self._tables(var)]
        if own in self.graph.nodes or not met:
            raise ValueError(f"{what} at {own}")
        narrowed = self.where(F.col(f"{var}__label").isin(met))
        return narrowed._with(narrowed.df, self.labels | {var: met[0]}) if len(met) == 1 else narrowed

    def _tables(self, var: str) -> list[str]:
        """The labels of the tables that var's nodes may be of."""
        own = self.labels[var]
        return own.split("|") if "|" in own or own in self.graph.nodes else [n.label for n in self.graph.tables_of(*own.split(":"))]

    def _reduced(self) -> Match:
        """A sub-pattern that goes on after its first hop, over the rows that a filtered outer pattern needs."""
        if self.within is None or self._df is None:
            return self
        key = self.within.columns[0]
        df = self.df.join(self.within.select(F.col(key).alias("__within")), F.col(key) == F.col("__within"), "left_semi")
        return Match(self.graph, df, self.labels, self.used, self.outer, self.differ, True, types=self.types)

    def where(self, condition: Column) -> Match:
        return self._with(self._resolved(lambda df: df.where(condition)))

    def hint(self, name: str) -> Match:
        """A join hint for the next hop. "shuffle_hash": these rows, few for each node, are hashed and the hop's are not sorted."""
        return self._with(self.df.hint(name))

    def clause(self) -> Match:
        """The next MATCH over the same bindings."""
        return self._with(self.df, used=())

    def out(self, from_: str, type_: str, to: str, rel: str | None = None) -> Match:
        """(from_)-[rel:type_]->(to); a `to` that is bound already closes a cycle."""
        return self._hop(from_, type_, to, rel, forward=True)

    def into(self, from_: str, type_: str, to: str, rel: str | None = None) -> Match:
        """(from_)<-[rel:type_]-(to)."""
        return self._hop(from_, type_, to, rel, forward=False)

    def both(self, from_: str, type_: str, to: str, rel: str | None = None) -> Match:
        """(from_)-[rel:type_]-(to) for a type between nodes of one label; a self-loop matches once."""
        e = self.graph.edge(type_)
        if e.source != e.target:
            met = [x for x in (e.source, e.target) if self._bound(from_) and x in self._tables(from_)]
            if len(met) == 2:
                raise ValueError(f"{type_} both starts and ends at {self.labels[from_]}: match each label of its own")
            return self.out(from_, type_, to, rel) if met == [e.source] else self.into(from_, type_, to, rel)
        rows = self.graph.edge_rows(type_)
        swapped = rows.where("src != dst").withColumns({"src": F.col("dst"), "dst": F.col("src")})
        return self._at(from_, (e.source,), f"{type_} does not start")._join(from_, e.target, to, rel, (type_,), rows.unionByName(swapped), F.col("src"), F.col("dst"))

    def any(self, from_: str, to: str, types: list[str] | None = None, rel: str | None = None, forward: bool = True) -> Match:
        """(from_)-[rel:A|B]->(to), without types any that starts (or, backward, ends) at from_'s label.

        rel has its type and no properties. Where the types end at one label, (to) has its properties, else the columns
        id and label alone.
        """
        near, far = ("source", "target") if forward else ("target", "source")
        if not self._bound(from_):
            raise KeyError(f"{from_} is not bound")
        here = self._tables(from_)
        wanted = [t for t in (sorted(self.graph.edges) if types is None else types) if getattr(self.graph.edge(t), near) in here]
        if not wanted:
            raise ValueError(f"none of the types {'starts' if forward else 'ends'} at {self.labels[from_]}")
        name = rel or f"_r{next(_unnamed)}"
        rows, ends = relationships(self.graph, wanted), {getattr(self.graph.edge(t), far) for t in wanted}
        at, to_end = (F.col("src"), F.col("dst")) if forward else (F.col("dst"), F.col("src"))
        if len(ends) == 1 and len(here) == 1:
            return self._join(from_, ends.pop(), to, name, tuple(wanted), rows, at, to_end, ("type",))
        if self._bound(to):
            raise ValueError("types that start or end at several labels cannot close a cycle")
        label_of = lambda side: F.create_map(*[F.lit(x) for t in wanted for x in (t, getattr(self.graph.edge(t), side))])[F.col("type")]
        edge = rows.select(at.alias(f"{name}__near"), label_of(near).alias(f"{name}__nearlabel"), to_end.alias(f"{to}__id"), label_of(far).alias(f"{to}__label"), F.col("type").alias(f"{name}__type"), F.col("eid").alias(f"{name}__eid"))
        met = F.col(f"{from_}__id") == F.col(f"{name}__near")
        if len(here) > 1:
            met &= F.col(f"{from_}__label") == F.col(f"{name}__nearlabel")
        df = self._reduced().df.join(edge, met).drop(f"{name}__near", f"{name}__nearlabel")
        return self._using(df, self.labels | {to: "|".join(sorted(ends))}, Used(frozenset(wanted), f"{name}__eid"))

    def path(self, from_: str, type_: str, to: str, least: int, most: int, name: str, forward: bool = True) -> Match:
        """name = (from_)-[:type_*least..most]->(to), for a type between nodes of one label, none of it used twice.

        Binds name.nodes and name.eids (lists, in order) and name.length. Starts are searched once each, however many rows
        have them; the joins are unrolled, so most should be small.
        """
        e = self.graph.edge(type_)
        if e.source != e.target:
            raise ValueError(f"{type_} does not lead from {e.source} to itself")
        if (at := self._at(from_, (e.source,), f"{type_} does not start")) is not self:
            return at.path(from_, type_, to, least, most, name, forward)
        rows = self.graph.edge_rows(type_).select("src", "dst", "eid")
        rows = rows if forward else rows.withColumns({"src": F.col("dst"), "dst": F.col("src")})
        walks = var_length(rows, self.df.select(F.col(f"{from_}__id").alias("id")).distinct(), least, most)
        walks = walks.select(F.col("start").alias(f"{name}__start"), F.col("end").alias(f"{name}__end"), F.col("hops").alias(f"{name}__length"), F.col("trail").alias(f"{name}__eids"), F.col("nodes").alias(f"{name}__nodes"))
        df = self.df.join(walks, F.col(f"{from_}__id") == F.col(f"{name}__start"))
        if self._bound(to):
            df = df.where(F.col(f"{to}__id") == F.col(f"{name}__end"))
        else:
            df = df.join(nodes_as(self.graph, e.target, to), F.col(f"{name}__end") == F.col(f"{to}__id"))
        return self._using(df.drop(f"{name}__start", f"{name}__end"), self.labels | {to: e.target}, Used(frozenset([type_]), f"{name}__eids", "path"))

    def _hop(self, from_: str, type_: str, to: str, rel: str | None, forward: bool) -> Match:
        e = self.graph.edge(type_)
        start, end = (e.source, e.target) if forward else (e.target, e.source)
        m = self._at(from_, (start,), f"{type_} does not {'start' if forward else 'end'}")._reduced()
        here = (e.on == "source") == forward
        if e.on and self._bound(to) and not rel and m._df is not None:
            # A foreign key that closes a cycle is a condition on its column.
            own, other = (from_, to) if here else (to, from_)
            key = f"{own}__{e.dst if e.on == 'source' else e.src}"
            if key in m.df.columns:
                return m._using(m.df.where(F.col(key) == F.col(f"{other}__id")), m.labels, Used(frozenset([e.type]), f"{own}__id", "key"))
        if e.on and not self._bound(to) and not rel:
            if not here or m._df is None or f"{from_}__{e.dst if e.on == 'source' else e.src}" in m.df.columns:
                return m._by_key(e, from_, to, end, key_is_here=here)
        rows = self.graph.edge_rows(type_)
        return m._join(from_, end, to, rel, (type_,), rows, F.col("src" if forward else "dst"), F.col("dst" if forward else "src"))

    def _by_key(self, e: EdgeTable, from_: str, to: str, end: str, key_is_here: bool) -> Match:
        """A foreign key: the far node's table joins without an edge table. The row that holds the key is the relationship."""
        far = nodes_as(self.graph, end, to)
        key = e.dst if e.on == "source" else e.src
        used = Used(frozenset([e.type]), f"{from_ if key_is_here else to}__id", "key")
        if self._df is None and not key_is_here:
            # A sub-pattern begins with the rows that hold the key; the outer rows are joined to them at its end.
            df = far.withColumn(f"{from_}__id", F.col(f"{to}__{key}").cast("long")).where(F.col(f"{from_}__id").isNotNull())
            return self._using(df, self.labels | {to: end}, used)
        here = F.col(f"{from_}__{key}") if key_is_here else F.col(f"{from_}__id")
        there = F.col(f"{to}__id") if key_is_here else F.col(f"{to}__{key}")
        return self._using(self.df.join(far, here == there), self.labels | {to: end}, used)

    def _join(self, from_: str, end: str, to: str, rel: str | None, types: tuple[str, ...], rows: DataFrame, near: Column, far: Column, more: tuple[str, ...] = ()) -> Match:
        name = rel or f"_r{next(_unnamed)}"
        own = more or tuple(self.graph.edge(types[0]).properties)
        named = [F.col("src").alias(f"{name}__src"), F.col("dst").alias(f"{name}__dst")] if rel else []
        begun = self._df is not None
        edge = rows.select(near.alias(f"{name}__near" if begun else f"{from_}__id"), far.alias(f"{name}__far"), F.col("eid").alias(f"{name}__eid"), *named, *[F.col(p).alias(f"{name}__{p}") for p in own])
        closes = self._bound(to)
        if begun:
            # A hop that closes a cycle is looked up by both of its ends, so that the open path is never made.
            met = F.col(f"{from_}__id") == F.col(f"{name}__near")
            df = self._reduced().df.join(edge, met & (F.col(f"{to}__id") == F.col(f"{name}__far")) if closes else met)
        else:
            df = edge.where(F.col(f"{to}__id") == F.col(f"{name}__far")) if closes else edge
        if not closes:
            df = df.join(nodes_as(self.graph, end, to), F.col(f"{name}__far") == F.col(f"{to}__id"))
        return self._using(df.drop(f"{name}__near", f"{name}__far"), self.labels | {to: end}, Used(frozenset(types), f"{name}__eid"))

    def part(self, var: str, label: str, on: Column | None = None) -> Match:
        """A further pattern part; without a condition it is a Cartesian product, so say so by on=F.lit(True)."""
        if on is None:
            raise ValueError("a part that shares no variable needs a condition; F.lit(True) allows the product")
        if self._bound(var):
            raise ValueError(f"{var} is bound already")
        far = nodes_as(self.graph, label, var)
        return self._with(self._resolved(lambda df: df.join(far, on)), self.labels | {var: label})

    def also(self, other: Match) -> Match:
        """Another pattern of the same clause that shares variables: an equi-join on their ids. Its relationships are others."""
        shared = [x for x in self.labels if x in other.labels]
        if not shared:
            raise ValueError("the parts share no variable")
        right = other.df.drop(*[c for x in shared for c in other.df.columns if c.startswith(f"{x}__") and c != f"{x}__id"])
        if both := set(self.df.columns) & set(right.columns) - {f"{x}__id" for x in shared}:
            raise ValueError(f"the parts share the columns {sorted(both)}")
        made = self._with(self.df.join(right, [f"{x}__id" for x in shared]), self.labels | other.labels)
        for new in other.used:
            checked = self._using(made.df, made.labels, new)
            made = made._with(checked.df)
        out = made._with(made.df, used=self.used + other.used, differ=self.differ and other.differ)
        out.types = self.types | other.types
        return out

    def with_(self, *variables: str, distinct: bool = False, **items: Column) -> Match:
        """WITH: the variables, whole, and items under their names; the rest is out of scope."""
        kept = [c for c in self.df.columns if c.split("__")[0] in variables and "__" in c or c in variables]
        df = self._resolved(lambda df: df.select(*kept, *[x.alias(n) for n, x in items.items()]))
        return self._with(df.distinct() if distinct else df, {k: x for k, x in self.labels.items() if k in variables}, (), differ=distinct)

    def group(self, *variables: str, **aggs: Column) -> Match:
        """WITH variables and aggregates, grouped by the variables."""
        kept = [c for c in self.df.columns if c.split("__")[0] in variables and "__" in c or c in variables]
        df = self._resolved(lambda df: df.groupBy(*kept).agg(*[a.alias(n) for n, a in aggs.items()]))
        return self._with(df, {k: x for k, x in self.labels.items() if k in variables}, (), differ=True)

    def order_by(self, *order: Column) -> Match:
        """ORDER BY, for a skip() or limit() that follows; see nulls_last and nulls_first."""
        return self._with(self.df.orderBy(*order))

    def skip(self, n: int) -> Match:
        return self._with(self.df.offset(n))

    def limit(self, n: int) -> Match:
        return self._with(self.df.limit(n))

    def _identities(self, names: list[str]) -> list[str]:
        """The columns that tell the values of variables apart; an item of WITH is one itself."""
        own = {c for c in self.df.columns if _variable(c) in names}
        marks = ("__id", "__eid", "__eids", "__label")
        return sorted(c for c in own if c in names or c.endswith(marks) and _variable(c) + c[c.rindex("__") :] == c)

    def _sub(self, from_: str, build: Callable[[Match], Match], once: bool) -> tuple[DataFrame, list[str], Match]:
        """A sub-pattern's rows, the columns of self that they belong to, and the pattern. It imports what it mentions.

        once: an outer value counts once, however many rows have it (not needed where only existence is asked for).
        """
        imported: list[str] = []
        while True:
            seed, keys = self._seed(from_, imported, once)
            try:
                inner = build(seed)
                return inner.df, keys, inner
            except Unbound as e:
                if e.name in imported or e.name != from_ and e.name not in {_variable(c) for c in self.df.columns}:
                    raise
                imported.append(e.name)

    def _seed(self, from_: str, imported: list[str], once: bool) -> tuple[Match, list[str]]:
        if not self._bound(from_):
            raise KeyError(f"{from_} is not bound")
        around = self.outer | ({_variable(c) for c in self.df.columns} if self._df is not None else set())
        if not imported and self.labels[from_] in self.graph.nodes:
            # Begun by its first hop. The ids of a filtered start are worth a semi-join before a second one.
            within = self.df.select(f"{from_}__id") if self._df is not None and self.narrow and not self.used else None
            return Match(self.graph, None, {from_: self.labels[from_]}, outer=frozenset(around - {from_}), within=within), [f"{from_}__id"]
        names = [from_, *[x for x in imported if x != from_]]
        keys = self._identities(names)
        df = self.df.select(*[c for c in self.df.columns if _variable(c) in names])
        if once and not (self.differ and set(keys) >= set(self._identities([_variable(c) for c in self.df.columns]))):
            df = df.dropDuplicates(keys)
        return Match(self.graph, df, {k: x for k, x in self.labels.items() if k in names}, outer=frozenset(around - set(names)), narrow=True), keys

    def _joined(self, rows: DataFrame, keys: list[str], how: str, from_: str) -> DataFrame:
        """self.df joined on keys with rows, which have them under other names."""
        renamed = {k: f"__key{i}" for i, k in enumerate(keys)}
        right = rows.select(*[F.col(c).alias(renamed.get(c, c)) for c in rows.columns])
        on = F.lit(True)
        for k, r in renamed.items():
            on &= F.col(k) == F.col(r) if _variable(k) == from_ else F.col(k).eqNullSafe(F.col(r))
        out = self.df.join(right, on, how)
        return out if how in ("left_semi", "left_anti") else out.drop(*renamed.values())

    def _widened(self, from_: str, rows: DataFrame, keys: list[str], inner: Match, how: str) -> Match:
        """self with the columns that a sub-pattern has added, as another clause."""
        known = {_variable(k) for k in keys}
        new = [c for c in rows.columns if _variable(c) not in known]
        if clash := sorted(set(new) & set(self.df.columns)):
            raise ValueError(f"the sub-pattern binds {clash} again")
        df = self._joined(rows.select(*keys, *new), keys, how, from_)
        out = self._with(df, self.labels | {k: x for k, x in inner.labels.items() if k not in known}, (), differ=self.differ and inner.differ)
        out.types = inner.types | self.types
        return out

    def call(self, from_: str, build: Callable[[Match], Match], order: list[Column] | None = None, limit: int | None = None, **aggs: tuple[Column, Column]) -> Match:
        """CALL { WITH from_, ... RETURN ... ORDER BY order LIMIT limit }: rows of the sub-query for each outer row, none
        without any. Rows are ranked for each value of what it imports; Spark keeps limit of them in each task before the
        shuffle. With aggregates, as in aggregate(), the sub-query has one row whatever it matches."""
        if aggs:
            return self.aggregate(from_, build, **aggs)
        df, keys, inner = self._sub(from_, build, once=True)
        if limit is not None:
            if not order:
                raise ValueError("a limit needs an order")
            df = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rank") <= limit).drop("__rank")
        return self._widened(from_, df, keys, inner, "inner")

    def labels_of(self, var: str) -> Column:
        """labels(var): the table's label and its further ones."""
        n = self.graph.node(self.labels[var])
        return F.array(*map(F.lit, (n.label, *n.labels)))

    def element_id(self, var: str) -> Column:
        """elementId(var): the label of its table and its id."""
        label = F.col(f"{var}__label") if f"{var}__label" in self.df.columns else F.lit(self.labels[var])
        return F.concat_ws(":", label, F.col(f"{var}__id").cast("string"))

    def end_of(self, rel: str, side: str, var: str) -> Match:
        """startNode(rel) or endNode(rel), side start or end, as a node `var` with its properties."""
        e = self.graph.edge(self.types[rel])
        label, column = (e.source, "src") if side == "start" else (e.target, "dst")
        if self._bound(var):
            raise ValueError(f"{var} is bound already")
        df = self.df.join(nodes_as(self.graph, label, var), F.col(f"{rel}__{column}") == F.col(f"{var}__id"))
        return self._with(df, self.labels | {var: label})

    def nodes_of(self, path: str, var: str) -> Match:
        """nodes(path) with properties: a column var, the nodes along it as structs (id, properties), in order."""
        type_ = next(iter(next(u.types for u in self.used if u.column == f"{path}__eids")))
        nodes = nodes_as(self.graph, self.graph.edge(type_).source, "__n")
        return self._along(path, f"{path}__nodes", nodes, "__n__id", "__n__", var)

    def relationships_of(self, path: str, var: str) -> Match:
        """relationships(path) with properties: a column var, those along it as structs (eid, src, dst, properties)."""
        type_ = next(iter(next(u.types for u in self.used if u.column == f"{path}__eids")))
        rows = self.graph.edge_rows(type_)
        return self._along(path, f"{path}__eids", rows.select(*[F.col(c).alias(f"__n__{c}") for c in rows.columns]), "__n__eid", "__n__", var)

    def _along(self, path: str, column: str, rows: DataFrame, key: str, prefix: str, var: str) -> Match:
        """Each distinct list of ids is looked up once; paths of no relationship have an empty list of them."""
        lists = self.df.select(F.col(column).alias("__list")).distinct()
        each = lists.select("__list", F.posexplode("__list").alias("__at", "__one"))
        own = F.struct(*[F.col(c).alias(c.removeprefix(prefix)) for c in rows.columns])
        made = each.join(rows, F.col("__one") == F.col(key)).groupBy("__list").agg(F.array_sort(F.collect_list(F.struct("__at", own.alias("row")))).alias("__rows"))
        made = lists.join(made, "__list", "left").select("__list", F.coalesce(F.col("__rows.row"), F.array()).alias(var))
        df = self.df.join(made, F.col(column) == F.col("__list")).drop("__list")
        return self._with(df)

    def type_of(self, rel: str) -> Column:
        """type(rel) of a named relationship."""
        if f"{rel}__type" in self.df.columns:
            return F.col(f"{rel}__type")
        return F.lit(self.types[rel])

    def _properties(self, var: str) -> list[str]:
        inner = {"id", "eid", "src", "dst"}
        return [p for c in self.df.columns if c.startswith(f"{var}__") and (p := c.removeprefix(f"{var}__")) not in inner]

    def keys_of(self, var: str) -> Column:
        """keys(var): the names of its properties that are not null."""
        return F.array_compact(F.array(*[F.when(F.col(f"{var}__{p}").isNotNull(), F.lit(p)) for p in self._properties(var)]))

    def properties_of(self, var: str) -> Column:
        """properties(var) as a struct."""
        return F.struct(*[F.col(f"{var}__{p}").alias(p) for p in self._properties(var)])

    def optional(self, from_: str, build: Callable[[Match], Match]) -> Match:
        """OPTIONAL MATCH: what build adds to the row, or nulls. Its filters belong inside build; what follows is another MATCH."""
        df, keys, inner = self._sub(from_, build, once=True)
        return self._widened(from_, df, keys, inner, "left")

    def _matched(self, from_: str, build: Callable[[Match], Match], how: str) -> Match:
        df, keys, _ = self._sub(from_, build, once=False)
        return self._with(self._joined(df.select(*keys), keys, how, from_))

    def exists(self, from_: str, build: Callable[[Match], Match]) -> Match:
        """WHERE EXISTS { (from_)… }: a semi-join."""
        return self._matched(from_, build, "left_semi")

    def not_exists(self, from_: str, build: Callable[[Match], Match]) -> Match:
        return self._matched(from_, build, "left_anti")

    def exists_flag(self, from_: str, build: Callable[[Match], Match], name: str) -> Match:
        """EXISTS as a boolean column, for use inside OR and projections."""
        df, keys, _ = self._sub(from_, build, once=False)
        out = self._joined(df.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left", from_)
        return self._with(out.withColumn(name, F.coalesce(name, F.lit(False))))

    def aggregate(self, from_: str, build: Callable[[Match], Match], **aggs: tuple[Column, Column]) -> Match:
        """COUNT { }, COLLECT { } and pattern comprehensions: name=(aggregate, value without a match), grouped by what the
        sub-pattern imports before the join."""
        df, keys, _ = self._sub(from_, build, once=True)
        out = self._joined(df.groupBy(*keys).agg(*[a.alias(n) for n, (a, _) in aggs.items()]), keys, "left", from_)
        return self._with(out.withColumns({n: F.coalesce(F.col(n), none) for n, (_, none) in aggs.items()}))

    def count_of(self, from_: str, build: Callable[[Match], Match], name: str) -> Match:
        return self.aggregate(from_, build, **{name: (F.count(F.lit(1)), F.lit(0).cast("long"))})

    def unwind(self, values: Column, name: str) -> Match:
        """One row per element; null and empty lists give none."""
        return self._with(self._resolved(lambda df: df.withColumn(name, F.explode(values))), differ=False)

    def returns(self, distinct: bool = False, **items: Column) -> DataFrame:
        """RETURN without aggregates, under the names given."""
        df = self.df.select(*[c.alias(n) for n, c in items.items()])
        return df.distinct() if distinct else df

    def returns_all(self) -> DataFrame:
        """RETURN *: every variable that has a name as a struct of its id and properties, in the order of binding."""
        names = list(dict.fromkeys(_variable(c) for c in self.df.columns if not c.startswith("_")))
        own = lambda n: [c for c in self.df.columns if _variable(c) == n and c != n]
        return self.df.select(*[F.struct(*[F.col(c).alias(c.removeprefix(f"{n}__")) for c in own(n)]).alias(n) if own(n) else F.col(n) for n in names])

    def returns_grouped(self, keys: dict[str, Column], **aggs: Column) -> DataFrame:
        """RETURN with implicit grouping: the items that are no aggregates are the keys."""
        return self.df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*[a.alias(n) for n, a in aggs.items()])


def nodes_as(graph: GraphCatalog, label: str, var: str) -> DataFrame:
    """A label's nodes under a variable's column names."""
    n = graph.node(label)
    return n.df.select(F.col(n.key).cast("long").alias(f"{var}__id"), *[F.col(c).alias(f"{var}__{c}") for c in n.properties if c != "id"])


def start(graph: GraphCatalog, var: str, label: str) -> Match:
    """MATCH (var:label), or (var:A:B) for nodes with several labels.

    Where one table has these labels it is matched as that table's label. Nodes of several tables have the columns of
    all, with nulls, and var.label, the label of their table; hops from them need a table's own label.
    """
    wanted = label.split(":")
    if len(wanted) == 1 and label in graph.nodes:
        return Match(graph, nodes_as(graph, label, var), {var: label})
    tables = graph.tables_of(*wanted)
    if len(tables) == 1:
        return Match(graph, nodes_as(graph, tables[0].label, var), {var: tables[0].label})
    df = None
    for n in tables:
        part = nodes_as(graph, n.label, var).withColumn(f"{var}__label", F.lit(n.label))
        df = part if df is None else df.unionByName(part, allowMissingColumns=True)
    return Match(graph, df, {var: label})


def relationships(graph: GraphCatalog, types: list[str]) -> DataFrame:
    """(type, src, dst, eid) of alternative types, [:A|B]."""
    parts = [graph.edge_rows(t).select(F.lit(t).alias("type"), "src", "dst", "eid") for t in types]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nulls_last(column: Column) -> Column:
    """Ascending order of graph queries: nulls come last."""
    return column.asc_nulls_last()


def nulls_first(column: Column) -> Column:
    """Descending order: nulls come first."""
    return column.desc_nulls_first()
