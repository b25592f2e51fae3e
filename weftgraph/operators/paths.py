"""Paths and traversals over an edge DataFrame (src, dst, and eid where relationships must not repeat)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.lineage import materialized


def undirected(edges: DataFrame) -> DataFrame:
    """Both orientations of each edge; a self-loop once."""
    swapped = edges.where("src != dst").withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(swapped)


def var_length(edges: DataFrame, starts: DataFrame, least: int, most: int) -> DataFrame:
    """(start, end, hops, trail, nodes) of all paths of least to most relationships, none of which repeats (trail: their
    eids; nodes: the ids along it, both ends included).

    starts has a column id. The joins are unrolled, so most should be small; reachable() serves longer distances.
    """
    if not 0 <= least <= most:
        raise ValueError("0 <= least <= most is needed")
    walk = starts.select(F.col("id").cast("long").alias("start"), F.col("id").cast("long").alias("end"), F.lit(0).alias("hops"), F.array().cast("array<bigint>").alias("trail"), F.array(F.col("id").cast("long")).alias("nodes"))
    found = [walk] if least == 0 else []
    step = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("eid").alias("__e"))
    for k in range(1, most + 1):
        met = walk.join(step, F.col("end") == F.col("__s")).where(~F.array_contains("trail", F.col("__e")))
        walk = met.select("start", F.col("__d").alias("end"), F.lit(k).alias("hops"), F.concat("trail", F.array("__e")).alias("trail"), F.concat("nodes", F.array("__d")).alias("nodes"))
        if k >= least:
            found.append(walk)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _steps(edges: DataFrame) -> DataFrame:
    """The distinct (src, dst) of a graph as a table, so that what makes them runs once and not at each level."""
    return materialized(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "step")


def reachable(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(seed, node, distance) for all nodes within most hops of each seed, the seed itself at 0.

    A breadth-first search for all seeds at once: each level joins the frontier with the edges and drops what was seen.
    closure() has no bound of hops.
    """
    step = _steps(edges).toDF("__s", "__d")
    seen = materialized(seeds.select(F.col("id").cast("long").alias("seed"), F.col("id").cast("long").alias("node"), F.lit(0).alias("distance")).distinct(), "level")
    frontier = seen
    for k in range(1, most + 1):
        met = frontier.join(step, F.col("node") == F.col("__s")).select("seed", F.col("__d").alias("node")).distinct()
        frontier = materialized(met.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(k)), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def closure(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(seed, node, distance) for every node that a seed reaches over any number of hops, itself at 0; without seeds, from
    all nodes that have an edge.

    Reach doubles: a pair at a distance of 2^k + d (d up to 2^k) is one at exactly 2^k and one at d, so there are as many
    rounds as the longest shortest path has binary digits, and no pair is made twice over one node. Reach is found for all
    nodes, then kept for the seeds: it serves many seeds; for a few of them reachable() holds less.
    """
    near = materialized(_steps(edges).where("src != dst").select("src", "dst", F.lit(1).cast("long").alias("distance")), "reach")
    parts, reach, k = [near], near, 1
    while True:
        far = reach.where(F.col("distance") == k).select(F.col("src").alias("__a"), F.col("dst").alias("__m"))
        made = far.join(reach, F.col("__m") == F.col("src")).where("__a != dst").groupBy(F.col("__a").alias("src"), "dst").agg((F.min("distance") + k).alias("distance"))
        new = materialized(made.join(reach.select("src", "dst"), ["src", "dst"], "left_anti"), "reach")
        if new.isEmpty():
            break
        parts.append(new)
        reach, k = reach.unionByName(new), 2 * k
    ends = _steps(edges).select(F.explode(F.array("src", "dst")).alias("id")).distinct() if seeds is None else seeds.select(F.col("id").cast("long").alias("id")).distinct()
    found = reach.select(F.col("src").alias("seed"), F.col("dst").alias("node"), "distance")
    if seeds is not None:
        found = found.join(ends, F.col("seed") == F.col("id"), "left_semi")
    return found.unionByName(ends.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).cast("long").alias("distance")))


def reach_counts(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, reached, farthest): how many nodes a seed reaches over any number of hops, itself included, and how far they are.

    Nodes that lead to one node each, as in chains, are counted by jumps that double, with a row for each node and no pair
    of them. Those whose way forks or ends in a cycle are counted from closure().
    """
    step = _steps(edges).where("src != dst")
    out = materialized(step.groupBy("src").agg(F.count(F.lit(1)).alias("ways"), F.min("dst").alias("jump")), "ahead")
    ids = seeds.select(F.col("id").cast("long").alias("seed")).where("seed IS NOT NULL").distinct()
    live = out.where("ways = 1").select(F.col("src").alias("node"), "jump", F.lit(1).cast("long").alias("hops"))
    # A jump lands where nothing is known to go on: at a last node or at a fork.
    done, left = [], live.count()
    while left:
        known = _union([live.withColumn("over", F.lit(False)), *[x.withColumn("over", F.lit(True)) for x in done]])
        ahead = known.select(F.col("node").alias("__n"), F.col("jump").alias("__jump"), F.col("hops").alias("__hops"), "over")
        met = live.join(ahead, F.col("jump") == F.col("__n"), "left")
        jumped = materialized(met.select("node", F.coalesce("__jump", "jump").alias("jump"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops"), F.coalesce("over", F.lit(True)).alias("over")), "jumps")
        done.append(jumped.where("over").drop("over"))
        live, before = jumped.where("NOT over").drop("over"), left
        left = live.count()
        if left == before:
            # A way of a longer finite length would have shorter ones behind it that end in this round: these are cycles.
            break
    forks = out.where("ways > 1").select(F.col("src").alias("node"))
    ended = _union(done) if done else live.limit(0)
    counted = ended.join(forks.toDF("__fork"), F.col("jump") == F.col("__fork"), "left_anti").select(F.col("node").alias("seed"), (F.col("hops") + 1).alias("reached"), F.col("hops").alias("farthest"))
    plain = ids.join(out.select(F.col("src").alias("seed")), "seed", "left_anti").select("seed", F.lit(1).cast("long").alias("reached"), F.lit(0).cast("long").alias("farthest"))
    found = [plain, counted.join(ids, "seed", "left_semi")]
    rest = live.select("node").unionByName(forks) if left else forks
    if not rest.isEmpty():
        others = ids.join(out.select(F.col("src").alias("seed")), "seed", "left_semi").join(counted.select("seed"), "seed", "left_anti")
        found.append(closure(edges, others.select(F.col("seed").alias("id"))).groupBy("seed").agg(F.count(F.lit(1)).alias("reached"), F.max("distance").alias("farthest")))
    return _union(found)


class _Search:
    """Shortest paths between pairs, searched from both ends in turn.

    Level k of a side holds the nodes at distance k of each end, and in how many ways they are reached; no path is kept. A
    pair is met at distance d where level i of its source and level d - i of its target have a node in common.
    """

    def __init__(self, edges: DataFrame, pairs: DataFrame, most: int, ways: bool) -> None:
        self.step = _steps(edges)
        wanted = materialized(pairs.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")).where("source IS NOT NULL AND target IS NOT NULL").distinct(), "pairs")
        self.open, self.ways = wanted.where("source != target"), ways
        self.levels = {side: [self.open.select(F.col(side).alias("end"), F.col(side).alias("node"), F.lit(1).cast("long").alias("n")).distinct()] for side in ("source", "target")}
        self.seen = {side: own[0].select("end", "node") for side, own in self.levels.items()}
        self.rows = {side: own[0].count() for side, own in self.levels.items()}
        #: (source, target, node, distance, at): the nodes where pairs meet, at hops from the source.
        self.meets: list[DataFrame] = []
        self.found = [wanted.where("source = target").select("source", "target", F.lit(0).alias("distance"), F.lit(1).cast("long").alias("n"))]
        for d in range(1, most + 1):
            # The side with the smaller level goes on, so a few sources of many targets are searched from these alone.
            if not self._extend("source" if self.rows["source"] <= self.rows["target"] else "target"):
                break
            self._meet(d)
            if self.open.isEmpty():
                break

    def _extend(self, side: str) -> bool:
        """Another level of a side, for the ends that still have an open pair."""
        a, b = ("src", "dst") if side == "source" else ("dst", "src")
        ends = self.open.select(F.col(side).alias("end")).distinct()
        front = self.levels[side][-1].join(ends, "end", "left_semi")
        met = front.join(self.step, F.col("node") == F.col(a)).select("end", F.col(b).alias("node"), "n")
        met = met.groupBy("end", "node").agg(F.sum("n").alias("n")) if self.ways else met.select("end", "node", F.lit(1).cast("long").alias("n")).distinct()
        level = materialized(met.join(self.seen[side], ["end", "node"], "left_anti"), "bfs")
        self.levels[side].append(level)
        self.seen[side] = self.seen[side].unionByName(level.select("end", "node"))
        self.rows[side] = level.count()
        return self.rows[side] > 0

    def _meet(self, d: int) -> None:
        fore, back = self.levels["source"][-1], self.levels["target"][-1]
        from_, to = fore.select(F.col("end").alias("source"), "node", F.col("n").alias("__f")), back.select(F.col("end").alias("target"), "node", F.col("n").alias("__b"))
        # An end that has no level yet is met at itself.
        if len(self.levels["target"]) == 1:
            rows = self.open.withColumns({"node": F.col("target"), "__b": F.lit(1).cast("long")}).join(from_, ["source", "node"])
        elif len(self.levels["source"]) == 1:
            rows = self.open.withColumns({"node": F.col("source"), "__f": F.lit(1).cast("long")}).join(to, ["target", "node"])
        else:
            rows = self.open.join(from_, "source").join(to, ["target", "node"])
        met = materialized(rows.select("source", "target", "node", F.lit(d).alias("distance"), F.lit(len(self.levels["source"]) - 1).alias("at"), (F.col("__f") * F.col("__b")).alias("n")), "meet")
        self.meets.append(met)
        self.found.append(met.groupBy("source", "target", "distance").agg(F.sum("n").alias("n")))
        self.open = materialized(self.open.join(met.select("source", "target").distinct(), ["source", "target"], "left_anti"), "open")

    def lengths(self) -> DataFrame:
        return _union(self.found)

    def links(self) -> list[DataFrame]:
        """For each number of hops from the source, (source, target, node, next): the edges that shortest paths take there.

        Predecessors are looked up in the levels from where a pair meets, back to its source and on to its target.
        """
        out = []
        for side, a, b in (("source", "dst", "src"), ("target", "src", "dst")):
            carried = None
            own = F.col("at") if side == "source" else F.col("distance") - F.col("at")
            for k in range(len(self.levels[side]) - 1 if self.meets else 0, 0, -1):
                here = [m.where(own == k).select("source", "target", "node", "distance", "at") for m in self.meets]
                cur = _union(here + ([carried] if carried is not None else [])).distinct()
                level = self.levels[side][k - 1].select(F.col("end").alias(side), F.col("node").alias("__next"))
                edges = cur.join(self.step, F.col("node") == F.col(a)).select("source", "target", "node", "distance", "at", F.col(b).alias("__next")).join(level, [side, "__next"])
                edges = materialized(edges.select("source", "target", "node", "__next", "distance", "at"), "links")
                hops = F.lit(k - 1) if side == "source" else F.col("distance") - k
                pair = (F.col("__next").alias("node"), F.col("node").alias("next")) if side == "source" else (F.col("node"), F.col("__next").alias("next"))
                out.append(edges.select("source", "target", hops.alias("hop"), *pair))
                carried = edges.select("source", "target", F.col("__next").alias("node"), "distance", "at").distinct()
        if not out:
            return []
        rows = _union(out).distinct()
        longest = rows.agg(F.max("hop")).first()[0]
        return [] if longest is None else [rows.where(F.col("hop") == k).drop("hop") for k in range(longest + 1)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shortest_lengths(edges: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """(source, target, distance) for the pairs (source, target) that are within most hops; a node is at 0 from itself."""
    return _Search(edges, pairs, most, ways=False).lengths().drop("n")


def count_shortest_paths(edges: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """(source, target, distance, n): how many shortest paths, over distinct edges, lead from source to target."""
    return _Search(edges, pairs, most, ways=True).lengths()


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int, every: bool = False) -> DataFrame:
    """(source, target, distance, path) for the pairs (source, target) that are within most hops; path is the nodes' ids.

    One path for each pair, the least by its ids, or every shortest one. Paths are built only for pairs that were met, and
    only over edges that are on one of their shortest paths. Pairs of a node with itself have distance 0.
    """
    search = _Search(edges, pairs, most, ways=False)
    rows = search.lengths().select("source", "target", "distance", F.array("source").alias("path"))
    for k, links in enumerate(search.links()):
        last = F.element_at("path", -1)
        ahead = links.select(F.col("source").alias("__s"), F.col("target").alias("__t"), F.col("node").alias("__n"), F.col("next").alias("__next"))
        if not every:
            ahead = ahead.groupBy("__s", "__t", "__n").agg(F.min("__next").alias("__next"))
        going, done = rows.where(F.col("distance") > k), rows.where(F.col("distance") <= k)
        on = (F.col("source") == F.col("__s")) & (F.col("target") == F.col("__t")) & (last == F.col("__n"))
        going = going.join(ahead, on).select("source", "target", "distance", F.concat("path", F.array("__next")).alias("path"))
        rows = materialized(done.unionByName(going), "paths")
    return rows


#: Edges that a task shrinks to a forest at a time; as many or fewer that are left are settled by one task.
FOREST_EDGES = 1 << 20


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(child, parent): each node of a block of edges, with the smallest that the block's edges join it to, also itself."""

    def shrunk(block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, place = np.unique(np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1) for b in block]), return_inverse=True)
        label, (a, b) = np.arange(len(ids)), np.split(place, 2)
        while len(a):
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
            a, b = label[a], label[b]
            a, b = a[a != b], b[a != b]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["child", "parent"])

    block, rows = [], 0
    for batch in batches:
        block.append(batch)
        rows += batch.num_rows
        if rows >= FOREST_EDGES:
            yield from shrunk(block)
            block, rows = [], 0
    if rows:
        yield from shrunk(block)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the nodes with an edge; those that edges join, whatever their direction, share a component.

    Each task first shrinks its edges to a forest, block by block, without a shuffle. Then a node moves, in each round, to
    the one with the least hash among it and its neighbours, and edges go along. Hashes change with the round, so chains
    shrink by a share in each, in whatever order their ids are. What fits into a block ends the rounds.
    """
    ends = edges.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    schema = "child long, parent long"
    forest = materialized(ends.mapInArrow(_forest, schema), "forest")
    rows = materialized(forest.where("child != parent").select(F.col("parent").alias("a"), F.col("child").alias("b")).distinct(), "contracted")
    found, k = forest.select(F.col("child").alias("node")).distinct().withColumn("component", F.col("node")), 0
    while left := rows.count():
        if left <= FOREST_EDGES:
            to = materialized(rows.coalesce(1).mapInArrow(_forest, schema).toDF("__n", "__to"), "moved")
            return found.join(to, F.col("component") == F.col("__n"), "left").select("node", F.coalesce("__to", "component").alias("component"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        both = rows.select(F.explode(F.array(F.struct(F.col("a").alias("n"), rank("b").alias("m")), F.struct(F.col("b").alias("n"), rank("a").alias("m")))).alias("e")).select("e.n", "e.m")
        near = both.groupBy("n").agg(F.min("m").alias("m"))
        to = materialized(near.select(F.col("n").alias("__n"), F.least(rank("n"), F.col("m"))["id"].alias("__to")), "moved")
        moved = rows.join(to, F.col("a") == F.col("__n")).select(F.col("__to").alias("a"), "b").join(to, F.col("b") == F.col("__n")).select("a", F.col("__to").alias("b"))
        rows = materialized(moved.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "contracted")
        found = materialized(found.join(to, F.col("component") == F.col("__n"), "left").select("node", F.coalesce("__to", "component").alias("component")), "components")
        k += 1
    return found


#: A level of more than so many rows for each node of the graph is first cut to ends with open partners.
_MOST_GROWTH = 4


class _Within:
    """Shortest paths, direction ignored, between all nodes source < target of a group, whose pairs are never listed.

    Level k has the nodes at distance k of each node of a group. Pairs meet where two levels of one group share a node, so
    there are as many rows as meetings. Ends whose partners in their group and component are all found go no further.
    edges may repeat; they are read as they are for the first level, and made distinct only where a search goes beyond.
    """

    def __init__(self, edges: DataFrame, groups: DataFrame, most: int, ways: bool) -> None:
        own = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src != dst")
        self.edges, self.ways = own, ways
        self.both = own.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst")
        self.own = materialized(groups.select(F.col("id").cast("long").alias("end"), "group").where("end IS NOT NULL AND `group` IS NOT NULL").distinct(), "groups")
        self.levels = [self.own.select("end", "group", F.col("end").alias("node"), F.lit(1).cast("long").alias("n"))]
        self.found: list[DataFrame] = []
        self.step: DataFrame | None = None
        self.sizes: DataFrame | None = None
        self.most_rows: int | None = None
        for d in range(1, most + 1):
            if d % 2 and not self._extend():
                break
            self._meet(d)
        if not self.found:
            self._meet(0)

    def _extend(self) -> bool:
        """Another level. The graph leads both ways, so only the two levels before it can have its nodes."""
        if len(self.levels) == 1:
            first = self.own.join(self.both, F.col("end") == F.col("src")).select("end", "group", F.col("dst").alias("node")).distinct()
            self.levels.append(materialized(first.withColumn("n", F.lit(1).cast("long")), "bfs"))
            return not self.levels[-1].isEmpty()
        front, seen = self.levels[-1], _union(self.levels[-2:])
        if self._large(front):
            ends = self._open()
            if ends.isEmpty():
                return False
            front, seen = front.join(ends, "end", "left_semi"), seen.join(ends, "end", "left_semi")
        if self.step is None:
            self.step = _steps(self.both)
        met = front.join(self.step, F.col("node") == F.col("src")).select("end", "group", F.col("dst").alias("node"), "n", F.lit(False).alias("old"))
        # One grouping adds up the ways and tells what was seen before, so rows are shuffled once.
        n = F.sum("n") if self.ways else F.lit(1).cast("long")
        new = met.unionByName(seen.withColumn("old", F.lit(True))).groupBy("end", "group", "node").agg(n.alias("n"), F.max("old").alias("old"))
        self.levels.append(materialized(new.where("NOT old").drop("old"), "bfs"))
        return not self.levels[-1].isEmpty()

    def _large(self, level: DataFrame) -> bool:
        if self.most_rows is None:
            self.most_rows = _MOST_GROWTH * self.both.agg(F.approx_count_distinct("src")).first()[0]
        return level.count() > self.most_rows

    def _open(self) -> DataFrame:
        """The ends with a partner of their group and component that is not found."""
        have = _union(self.found).select(F.explode(F.array("source", "target")).alias("end")).groupBy("end").agg(F.count(F.lit(1)).alias("have"))
        lacking = lambda sizes: sizes.join(have, "end", "left").where("partners > coalesce(have, 0)").select("end")
        partners = (F.count(F.lit(1)) - 1).alias("partners")
        if self.sizes is None:
            # Without a partner that is not found, in whatever component, these are not asked for.
            ends = lacking(self.own.join(self.own.groupBy("group").agg(partners), "group"))
            if ends.isEmpty():
                return ends
            placed = self.own.join(components(self.edges).withColumnRenamed("node", "end"), "end")
            sizes = placed.groupBy("group", "component").agg(partners)
            self.sizes = materialized(placed.join(sizes, ["group", "component"]).select("end", "partners"), "partners")
        return materialized(lacking(self.sizes), "open")

    def _meet(self, d: int) -> None:
        one, other = self.levels[-1], self.levels[d - len(self.levels) + 1]
        rows = one.select(F.col("end").alias("a"), "group", "node", F.col("n").alias("__f")).join(other.select(F.col("end").alias("b"), "group", "node", F.col("n").alias("__b")), ["group", "node"])
        # Levels of one number meet from both ends; of two, each pair meets at it from either end, and counts from one.
        rows = rows.where("a < b").select(F.col("a").alias("source"), F.col("b").alias("target"), (F.col("__f") * F.col("__b")).alias("n"))
        met = rows.groupBy("source", "target").agg(F.sum("n").alias("n")) if self.ways else rows.select("source", "target", F.lit(1).cast("long").alias("n")).distinct()
        if self.found:
            met = met.join(_union(self.found).select("source", "target"), ["source", "target"], "left_anti")
        self.found.append(materialized(met.select("source", "target", F.lit(d).alias("distance"), "n"), "meet"))


def shortest_lengths_within(edges: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """(source, target, distance), direction ignored, for all nodes source < target of one group that are within most hops.

    groups has (id, group), a row for each node. Pairs that no path joins cost nothing, unlike in shortest_lengths().
    """
    return _union(_Within(edges, groups, most, ways=False).found).drop("n")


def count_shortest_paths_within(edges: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """(source, target, distance, n), as shortest_lengths_within(), with the number of shortest paths."""
    return _union(_Within(edges, groups, most, ways=True).found)


def neighbours(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """(id, neighbour) in one direction, or both; a row per relationship."""
    rows = {"out": edges, "in": edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}), "both": undirected(edges)}
    if direction not in rows:
        raise ValueError("direction is out, in or both")
    wanted = ids.select(F.col("id").cast("long").alias("id")).distinct()
    return rows[direction].join(wanted, F.col("src") == F.col("id")).select("id", F.col("dst").alias("neighbour"))


def degrees(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """(id, degree) for each id, 0 without relationships. Counted before the join, so hubs are no hot spots."""
    ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    if direction == "both":
        rows = edges.select(F.explode(F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))).alias("__n"))
    else:
        rows = edges.select(F.col(ends[0]).alias("__n"))
    counts = rows.groupBy("__n").agg(F.count(F.lit(1)).alias("degree"))
    return ids.select(F.col("id").cast("long").alias("id")).join(counts, F.col("id") == F.col("__n"), "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, neighbour), distinct, for the pairs (a, b); neither a nor b itself."""
    near = undirected(edges.select("src", "dst")).distinct()
    one = pairs.distinct().join(near, F.col("a") == F.col("src")).select("a", "b", F.col("dst").alias("neighbour"))
    other = near.select(F.col("src").alias("b"), F.col("dst").alias("neighbour"))
    return one.join(other, ["b", "neighbour"], "left_semi").where("neighbour != a AND neighbour != b").select("a", "b", "neighbour")


def common_neighbours_within(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, neighbour), distinct, for all nodes a < b of one group; neither a nor b itself. groups has (id, group).

    Nodes meet over a group and a neighbour, so pairs of a group without one are never made.
    """
    own = groups.select(F.col("id").cast("long").alias("a"), "group").where("a IS NOT NULL AND `group` IS NOT NULL").distinct()
    near = undirected(edges.select("src", "dst")).join(own, F.col("src") == F.col("a")).select("a", "group", F.col("dst").alias("neighbour")).distinct()
    met = near.join(near.withColumnRenamed("a", "b"), ["group", "neighbour"])
    return met.where("a < b AND neighbour != a AND neighbour != b").select("a", "b", "neighbour")


def path_exists(edges: DataFrame, pairs: DataFrame, most: int = 5) -> DataFrame:
    """(source, target, connected) for each pair, over edges in their direction."""
    found = shortest_lengths(edges, pairs, most).select("source", "target", F.lit(True).alias("connected"))
    wanted = pairs.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")).distinct()
    return wanted.join(found, ["source", "target"], "left").withColumn("connected", F.coalesce("connected", F.lit(False)))


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """The edges (src, dst) between nodes within depth hops of the seeds, direction ignored."""
    near = reachable(undirected(edges.select("src", "dst")), seeds, depth).select("node").distinct()
    half = edges.select("src", "dst").join(near.select(F.col("node").alias("src")), "src", "left_semi")
    return half.join(near.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
