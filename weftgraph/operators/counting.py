"""Counting the matches of a pattern without building them.

A pattern that is a tree is counted from its leaves: each edge gets the number of ways to go on behind it, edges are summed
by the node that they hang on, and the sums of several branches multiply. Relationships must differ from one another, which
is kept by subtraction: of all tuples of edges at a node, those that use one edge twice are taken away (inclusion and
exclusion over which branches share an edge). So no pair of edges is ever made, however many a node has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import factorial, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.match import Match, nodes_as
from weftgraph.sources.catalog import GraphCatalog


@dataclass(frozen=True)
class Hop:
    """A relationship of a tree and the node behind it: -[:type]->(to), or backward <-[:type]-(to).

    where is a condition on columns of `to` and of the relationship (rel__eid, rel__<property>); then has the hops from `to`.
    """

    type: str
    to: str
    forward: bool = True
    where: Column | None = None
    then: tuple[Hop, ...] = ()

    @property
    def plain(self) -> bool:
        return self.where is None and not self.then


def _walk(hops: Sequence[Hop], parent: Hop | None = None) -> Iterator[tuple[Hop, Hop | None]]:
    for h in hops:
        yield h, parent
        yield from _walk(h.then, h)


def _check(hops: Sequence[Hop], used: frozenset[str]) -> None:
    """Refuses trees in which two relationships could be the same one without meeting at a node in the same role."""
    if again := used & {h.type for h, _ in _walk(hops)}:
        raise ValueError(f"{sorted(again)} are in the pattern already; count that pattern by hops")
    for (a, above_a), (b, above_b) in combinations(_walk(hops), 2):
        if a.type != b.type:
            continue
        siblings = above_a is above_b and a.forward == b.forward
        there_and_back = (above_b is a or above_a is b) and a.forward != b.forward
        if not siblings and not there_and_back:
            raise ValueError(f"{a.type} occurs twice without meeting itself at a node; count that pattern by hops")


def _splits(items: list) -> Iterator[list[list]]:
    """All ways to split items into groups."""
    if not items:
        yield []
        return
    head, *tail = items
    for k in range(len(tail) + 1):
        for more in combinations(range(len(tail)), k):
            rest = [x for i, x in enumerate(tail) if i not in more]
            for others in _splits(rest):
                yield [[head, *(tail[i] for i in more)], *others]


def _times(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out * c
    return out


class _Branches:
    """Sibling hops of one type and direction: their edges' weights, and sums of their products by the node they hang on."""

    def __init__(self, graph: GraphCatalog, hops: list[Hop]) -> None:
        # Hops without conditions have one weight in common; of others each has its own.
        plain = [h for h in hops if h.plain]
        kinds = plain[:1] + [h for h in hops if not h.plain]
        self.of = [0 if h.plain else kinds.index(h) for h in hops]
        self.all_plain = len(plain) == len(hops)
        parts = [_edges(graph, h).withColumnRenamed("w", f"w{i}") for i, h in enumerate(kinds)]
        if len(parts) == 1:
            self.weights = parts[0]
        else:
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p, allowMissingColumns=True)
            self.weights = rows.groupBy("near", "eid").agg(*[F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"w{i}") for i in range(len(kinds))])
        self.members = list(range(len(hops)))

    def _sum_name(self, group: list[int]) -> str:
        """Branches of one kind have the same sums."""
        return "s" + "_".join(str(self.of[i]) for i in sorted(group, key=lambda i: self.of[i]))

    def sums(self) -> DataFrame:
        """(near, a sum for each group of branches that could share an edge)."""
        wanted = {self._sum_name(list(g)): list(g) for k in self.members for g in combinations(self.members, k + 1)}
        return self.weights.groupBy("near").agg(*[F.sum(_times([F.col(f"w{self.of[i]}") for i in g])).alias(n) for n, g in wanted.items()])

    def total(self, own: dict[int, Column] | None = None) -> Column:
        """The number of tuples of different edges, from the columns of sums(); with own, the weights of one edge that may not
        be among them."""
        out = F.lit(0).cast("long")
        for split in _splits([*self.members, *(["own"] if own is not None else [])]):
            sign = prod((-1) ** (len(g) - 1) * factorial(len(g) - 1) for g in split)
            factors = [F.lit(sign).cast("long")]
            for g in split:
                factors += [own[i] for i in g if i != "own"] if "own" in g else [F.col(self._sum_name(g))]
            out = out + _times(factors)
        return out


def _grouped(hops: Sequence[Hop]) -> list[list[Hop]]:
    out: dict[tuple[str, bool], list[Hop]] = {}
    for h in hops:
        out.setdefault((h.type, h.forward), []).append(h)
    return list(out.values())


def _edges(graph: GraphCatalog, hop: Hop) -> DataFrame:
    """(eid, near, w): the hop's edges that meet its conditions, with the number of ways to go on behind them."""
    e = graph.edge(hop.type)
    near, far, end = ("src", "dst", e.target) if hop.forward else ("dst", "src", e.source)
    rows = graph.edge_rows(hop.type).select("eid", F.col(near).alias("near"), F.col(far).alias("far"), F.col("eid").alias("rel__eid"), *[F.col(p).alias(f"rel__{p}") for p in e.properties])
    df = rows.join(nodes_as(graph, end, hop.to), F.col("far") == F.col(f"{hop.to}__id"))
    df = (df if hop.where is None else df.where(hop.where)).select("eid", "near", "far")
    ways = [F.lit(1).cast("long")]
    for k, group in enumerate(_grouped(hop.then)):
        behind = _Branches(graph, group)
        sums = behind.sums()
        df = df.join(sums.select(F.col("near").alias(f"at{k}"), *[c for c in sums.columns if c != "near"]), F.col("far") == F.col(f"at{k}")).drop(f"at{k}")
        own = None
        if group[0].type == hop.type and group[0].forward != hop.forward:
            if behind.all_plain:
                # The edge itself is one of those that lead on: the node before it exists, or its ways are never asked for.
                own = {i: F.lit(1).cast("long") for i in behind.members}
            else:
                back = behind.weights.select(F.col("eid").alias("back"), *[F.col(c).alias(f"own_{c}") for c in behind.weights.columns if c.startswith("w")])
                df = df.join(back, F.col("eid") == F.col("back"), "left").drop("back")
                own = {i: F.coalesce(F.col(f"own_w{behind.of[i]}"), F.lit(0)) for i in behind.members}
        df = df.withColumn(f"ways{k}", behind.total(own)).drop(*[c for c in df.columns if c not in ("eid", "near", "far") and not c.startswith("ways")])
        ways.append(F.col(f"ways{k}"))
    return df.select("eid", "near", _times(ways).alias("w")).where("w > 0")


def times(match: Match, from_: str, hops: Sequence[Hop], name: str) -> Match:
    """match with a column `name`: in how many ways its row goes on by the hops from from_; rows without any go.

    The sum of `name` over rows is the count of the pattern with these hops, whose relationships all differ. Hops of one
    type must meet at a node (siblings in one direction, or there and back), so that equal ones can be subtracted; other
    patterns raise ValueError, as do types that the pattern has used before. Counts beyond a long raise an error.
    """
    if from_ not in match.labels:
        raise KeyError(f"{from_} is not bound")
    _check(hops, frozenset(t for u in match.used for t in u.types))
    for h, above in _walk(hops):
        e = match.graph.edge(h.type)
        at = match.labels[from_] if above is None else (lambda a: a.target if above.forward else a.source)(match.graph.edge(above.type))
        if at != (e.source if h.forward else e.target):
            raise ValueError(f"{h.type} does not {'start' if h.forward else 'end'} at {at}")
    df, ways = match.df, [F.lit(1).cast("long")]
    for k, group in enumerate(_grouped(hops)):
        branches = _Branches(match.graph, group)
        sums = branches.sums()
        counted = sums.select(F.col("near").alias(f"__at{k}"), branches.total().alias(f"__ways{k}")).where(F.col(f"__ways{k}") > 0)
        df = df.join(counted, F.col(f"{from_}__id") == F.col(f"__at{k}")).drop(f"__at{k}")
        ways.append(F.col(f"__ways{k}"))
    df = df.withColumn(name, _times(ways)).drop(*[f"__ways{k}" for k in range(len(ways))])
    return Match(match.graph, df, match.labels, match.used, match.outer, match.differ, True, types=match.types)
