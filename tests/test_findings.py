"""Regressions: each of these failed before the change that came with it."""

import collections
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import cycles, paths, text, vector, vector_index, writes
from weftgraph.operators.bound import BoundPairs
from weftgraph.operators.counting import Hop
from weftgraph.operators.match import start
from weftgraph.operators.versions import Versions
from weftgraph.sources import tables
from weftgraph.sources.catalog import GraphCatalog


def test_edits_of_names_are_edits_of_bytes(spark):
    have = spark.createDataFrame([(10, "rereré"), (20, "größen"), (30, "tables")], "id long, name string")
    asked = spark.createDataFrame([("rerere",), ("rererè",), ("Größe",), ("tablës",), ("table",)], "name string")
    found = {r.name: (r.id, r.created) for r in text.resolved(asked, have).collect()}
    # One byte apart: é and è, a letter at the end. Two: e and é, e and ë.
    assert found == {"rererè": (10, False), "Größe": (20, False), "table": (30, False), "rerere": (31, True), "tablës": (32, True)}


def test_triples_of_names_two_bytes_apart_make_nodes(spark):
    have = spark.createDataFrame([(10, "rereré")], "id long, name string")
    found = spark.createDataFrame([(1, "rerere", "of", "RERERÉ")], "doc long, subject string, type string, object string")
    nodes, edges, told = text.upsert_triples(found, have, spark.createDataFrame([], "src long, type string, dst long"), "doc")
    assert [tuple(r) for r in nodes.collect()] == [(11, "rerere")] and [tuple(r) for r in edges.collect()] == [(11, "OF", 10)]
    assert {tuple(r) for r in told.collect()} == {(10, 1), (11, 1)}


def test_bound_pairs_are_counted_without_being_built(spark):
    nodes = lambda n, of: spark.createDataFrame([(i, of(i)) for i in range(n)], "id long, hub int")
    g = GraphCatalog().add_nodes("Hub", spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "id long, name string"), "id")
    g.add_nodes("L", nodes(6, lambda i: i % 2), "id").add_nodes("R", nodes(5, lambda i: (i % 3) if i else None), "id")
    g.add_foreign_key("L_OF", "L", "Hub", "hub", on="source").add_foreign_key("R_OF", "R", "Hub", "hub", on="source")
    links = [(0, 3), (0, 3), (1, 1), (1, 4), (3, 4), (2, 1), (5, 0)]
    g.add_edges("KNOWS", spark.createDataFrame([(i, *e) for i, e in enumerate(links)], "k int, a long, b long"), "L", "R", "a", "b", key=("k",))
    hub = start(g, "h", "Hub")
    knows = lambda x: x.out("l", "KNOWS", "r", rel="e")
    pairs = BoundPairs(hub, "h", Hop("L_OF", "l", forward=False), Hop("R_OF", "r", forward=False))
    own = [(h, i, j) for h in range(3) for i in range(6) for j in range(1, 5) if i % 2 == h and j % 3 == h]
    want = collections.Counter((h, links.count((i, j))) for h, i, j in own)
    counted = pairs.counted(knows, "k", "n")
    assert {(r["h__id"], r["k"]): r["n"] for r in counted.df.collect()} == want and {h for h, _ in want} == {0, 1}
    met = {(i, j): sorted(k for k, e in enumerate(links) if e == (i, j)) for _, i, j in own if (i, j) in links}
    assert {(r["l__id"], r["r__id"]): r["ks"] for r in pairs.aggregate(knows, ks=F.array_sort(F.collect_list("e__k"))).df.collect()} == met
    first = pairs.call(knows, [F.desc("e__k")], 1).df
    assert {(r["l__id"], r["r__id"]): r["e__k"] for r in first.collect()} == {p: max(ks) for p, ks in met.items()}
    with pytest.raises(ValueError):
        BoundPairs(hub, "h", Hop("L_OF", "l", forward=False), Hop("L_OF", "r", forward=False))
    with pytest.raises(ValueError):
        pairs.counted(lambda x: x.out("l", "L_OF", "h"), "k", "n")


def test_searches_within_groups_against_pairs(spark):
    rng = random.Random(3)
    # Three parts of the graph that no edge joins, groups across them, loops and equal edges.
    rows = [(rng.randrange(12) + 100 * part, rng.randrange(12) + 100 * part) for part in range(3) for _ in range(16)] + [(5, 5), (7, 8), (7, 8)]
    edges, ids = spark.createDataFrame(rows, "src long, dst long"), [i + 100 * p for p in range(3) for i in range(13)]
    group = {i: i % 3 if i % 7 else None for i in ids}
    groups = spark.createDataFrame([(i, g) for i, g in group.items()], "id long, group int")
    pairs = [(a, b) for a in ids for b in ids if a < b and group[a] is not None and group[a] == group[b]]
    steps = {a: {b for e in rows for b in e if a in e and b != a} for e in rows for a in e}
    want = set()
    for a, b in pairs:
        level, seen = {a: 1}, {a}
        for d in range(1, 5):
            ways = collections.Counter()
            for x, n in level.items():
                for y in steps.get(x, ()):
                    ways[y] += 0 if y in seen else n
            level = {x: n for x, n in ways.items() if n}
            seen |= set(level)
            if b in level:
                want.add((a, b, d, level[b]))
    assert {tuple(r) for r in paths.count_shortest_paths_within(edges, groups, 4).select("source", "target", "distance", "n").collect()} == want
    # Cut to open ends at every level, as large levels are.
    old, paths._MOST_GROWTH = paths._MOST_GROWTH, 0
    try:
        assert {tuple(r) for r in paths.shortest_lengths_within(edges, groups, 4).collect()} == {w[:3] for w in want}
    finally:
        paths._MOST_GROWTH = old
    shared = {tuple(r) for r in paths.common_neighbours(edges, spark.createDataFrame(pairs, "a long, b long")).distinct().collect()}
    met = paths.common_neighbours_within(edges, groups).collect()
    assert {tuple(r) for r in met} == shared and len(met) == len(shared)
    near = {a: {a} for e in rows for a in e}
    for a, b in rows:
        joined = near[a] | near[b]
        for x in joined:
            near[x] = joined
    found = {r["node"]: r["component"] for r in paths.components(edges).collect()}
    assert all((found[a] == found[b]) == (b in near[a]) for a in near for b in near) and set(found) == set(near)


def test_a_search_whose_pairs_are_found_writes_one_level(spark, monkeypatch):
    # Two parts that no edge joins, with equal edges; all nodes of a group and part share a neighbour.
    rows = [(i + 100 * part, 1000 * part + 50 + k) for part in range(2) for i in range(8) for k in (0, i % 3, 7)]
    edges = spark.createDataFrame(rows + rows, "src long, dst long")
    groups = spark.createDataFrame([(i + 100 * part, i % 2) for part in range(2) for i in range(8)], "id long, group int")
    written, real = [], paths.materialized
    monkeypatch.setattr(paths, "materialized", lambda df, name: written.append(name) or real(df, name))
    monkeypatch.setattr(paths, "_MOST_GROWTH", 0)
    found = {tuple(r) for r in paths.count_shortest_paths_within(edges, groups, 4).select("source", "target", "distance", "n").collect()}
    steps = {a: {b for x, b in rows if x == a} for a, _ in rows}
    assert found == {(a, b, 2, len(steps[a] & steps[b])) for a in steps for b in steps if a < b and a // 100 == b // 100 and a % 2 == b % 2}
    # The graph is neither written nor walked again: it took a table of its edges and an empty second level before.
    assert "step" not in written and written.count("bfs") == 1


def test_groups_whose_pairs_are_all_found_need_no_components(spark, monkeypatch):
    edges = spark.createDataFrame([(i, 50 + (i + k) % 6) for i in range(6) for k in range(4)], "src long, dst long")
    groups = spark.createDataFrame([(i, i % 2) for i in range(6)], "id long, group int")
    monkeypatch.setattr(paths, "_MOST_GROWTH", 0)
    asked, real = [], paths.components
    monkeypatch.setattr(paths, "components", lambda e: asked.append(e) or real(e))
    found = {tuple(r) for r in paths.shortest_lengths_within(edges, groups, 4).collect()}
    assert found == {(a, b, 2) for a in range(6) for b in range(a + 1, 6) if a % 2 == b % 2} and not asked


@pytest.mark.parametrize("most", [0, 8, 1 << 20])
def test_components_by_forests_and_rounds(spark, monkeypatch, most):
    rng = random.Random(7)
    rows = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)] + [(200, 200), (210 + 5, 210)]
    label = {x: x for e in rows for x in e}
    for _ in label:
        for a, b in rows:
            label[a] = label[b] = min(label[a], label[b])
    monkeypatch.setattr(paths, "FOREST_EDGES", most)
    batches = spark.createDataFrame(rows, "a long, b long").toArrow().to_batches(max_chunksize=3)
    forest = [(c, p) for x in paths._forest(iter(batches)) for c, p in zip(*(x.column(i).to_pylist() for i in (0, 1)))]
    assert {c for c, _ in forest} == set(label) and all(p <= c and label[p] == label[c] for c, p in forest)
    edges = spark.createDataFrame(rows + [(None, 3), (4, None)], "src long, dst long").repartition(5)
    found = {r["node"]: r["component"] for r in paths.components(edges).collect()}
    assert set(found) == set(label) and all((found[a] == found[b]) == (label[a] == label[b]) for a in label for b in label)


def test_search_goes_on_from_the_smaller_side(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    pairs = spark.createDataFrame([(0, i) for i in range(60)], "source long, target long")
    search = paths._Search(chain, pairs, 5, ways=False)
    assert len(search.levels["target"]) == 1 and len(search.levels["source"]) == 6
    assert {(r["target"], r["distance"]) for r in search.lengths().collect()} == {(i, i) for i in range(6)}
    assert {(r["target"], len(r["path"])) for r in paths.shortest_paths(chain, pairs, 5).collect()} == {(i, i + 1) for i in range(6)}


def test_centroids_and_probes_take_little_memory():
    rng = np.random.default_rng(1)
    units = rng.normal(size=(8000, 8))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    tracemalloc.start()
    book = vector_index.centroids(units, 2000, rounds=1)
    probes = vector_index.lists_to_probe(units, book)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The whole product would take 128 MB.
    assert most < 60e6 and 1 <= probes <= len(book)


def test_reach_is_counted_along_chains_forks_and_cycles(spark):
    rows = [(i, i + 1) for i in range(21)] + [(30, 5), (31, 30), (40, 41), (41, 42), (42, 40), (43, 40), (44, 43), (50, 51), (50, 52), (51, 53), (52, 53), (53, 54), (54, 55), (60, 50), (61, 60), (70, 70)]
    edges, ids = spark.createDataFrame(rows, "src long, dst long"), [*range(22), 30, 31, *range(40, 45), *range(50, 56), 60, 61, 70, 99]
    seeds = spark.createDataFrame([(i,) for i in ids], "id long")
    want = {(r["seed"], r["n"], r["far"]) for r in paths.closure(edges, seeds).groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).collect()}
    found = paths.reach_counts(edges, seeds).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(ids) and (0, 22, 21) in want and (44, 5, 4) in want
    chain = paths.reach_counts(edges.where("src < 21"), seeds.where("id < 22"))
    assert {tuple(r) for r in chain.collect()} == {(i, 22 - i, 21 - i) for i in range(22)}


def test_phrases_of_very_long_texts(spark):
    words = [["heat", "of", "the", "sea"][i % 4] for i in range(20_000)]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(8)], "doc long, text string")
    names = spark.createDataFrame([("Pair", "the sea"), ("Triple", "sea heat of")], "label string, name string")
    found = text.phrase_mentions(docs, "doc", "text", names).groupBy("doc", "name").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # "the sea" comes first each time and takes the word that the triple begins with.
    assert {tuple(r) for r in found.collect()} == {(i, "the sea", 5000, 2) for i in range(8)}


def test_exact_search_in_blocks_against_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    # Copies, a zero vector, nulls, NaN and infinity, and vectors of other lengths.
    vectors = [[float(x) for x in rng.integers(-2, 3, 3)] for _ in range(90)] + [[0.0] * 3, None, [1.0, None, 2.0], [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 0.0], [1.0, 2.0], [2.0, 1.0], []]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, e array<float>").repartition(3)
    asked = rows.where("id % 3 = 0").select(F.col("id").alias("query"), F.col("e").alias("vector"))
    monkeypatch.setattr(vector, "MOST_QUERIES", 11)
    monkeypatch.setattr(vector, "MOST_ROWS", 17)
    for similarity, score in (("cosine", vector.cosine), ("euclidean", vector.euclidean)):
        pairs = asked.crossJoin(rows).select("query", "id", score(F.col("e"), F.col("vector")).alias("score")).where("score IS NOT NULL").collect()
        want = {}
        for r in sorted(pairs, key=lambda r: (r.query, not np.isnan(r.score), 0 if np.isnan(r.score) else -r.score, r.id)):
            want.setdefault(r.query, []).append((r.id, repr(r.score)))
        found = {}
        df = vector.top_k_join(rows, asked, "id", "e", 5, similarity)
        for r in df.orderBy("query", "rank").collect():
            found.setdefault(r.query, []).append((r.id, repr(r.score)))
        assert found == {q: x[:5] for q, x in want.items()}
        # No pair of a query and a row is made in the plan.
        assert "NestedLoop" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan


def test_distinct_pairs_are_dealt_by_rows(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), (F.col("id") % 30).alias("b"))
    monkeypatch.setattr(tables, "ROWS_OF_TASK", 90)
    found = tables.distinct_pairs(rows, "a", "b")
    assert found.rdd.getNumPartitions() == 12 and sorted(map(tuple, found.collect())) == sorted({(i % 7, i % 30) for i in range(1000)})
    assert tables.distinct_pairs(rows.limit(0), "a", "b").count() == 0


def test_merged_edges_look_up_only_pairs(spark):
    edges = spark.createDataFrame([(1, 2, "x"), (1, 2, "y"), (2, 3, "z"), (None, 3, "n")], "src long, dst long, p string")
    pairs = spark.createDataFrame([(1, 2), (3, 1), (3, 1), (None, 3)], "src long, dst long")
    merged = writes.merge_edges(edges, pairs)
    assert sorted(map(str, merged.collect())) == sorted(map(str, [*edges.collect(), *edges.limit(0).unionByName(spark.createDataFrame([(3, 1, None), (None, 3, None)], edges.schema)).collect()]))
    # All relationships pass a semi join; before, they were told apart and looked up whole.
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_a_hinted_hop_hashes_its_nodes(spark):
    nodes = spark.createDataFrame([(i, i % 2) for i in range(8)], "id long, odd int")
    links = spark.createDataFrame([(i, i % 8, (3 * i) % 8) for i in range(40)], "k int, a long, b long")
    g = GraphCatalog().add_nodes("N", nodes, "id").add_nodes("M", nodes, "id")
    g.add_edges("ONE", links, "N", "N", "a", "b", key=("k",)).add_edges("TWO", links, "N", "M", "b", "a", key=("k",))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = start(g, "n", "N").where(F.col("n__odd") == 1).hint("shuffle_hash").any("n", "x", rel="r")
        found = m.returns_grouped({"type": m.type_of("r")}, n=F.count(F.lit(1)))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r["type"]: r["n"] for r in found.collect()} == {"ONE": 20, "TWO": 20}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_triangles_by_ids_or_by_neighbours(spark, monkeypatch):
    rng = random.Random(11)
    even = [(rng.randrange(30), rng.randrange(30)) for _ in range(150)]
    # Node -1 leads to more than the root of twice the number of edges.
    for rows, tables_written in ((even, 2), (even + [(-1, i) for i in range(30)], 3)):
        written = []
        monkeypatch.setattr(cycles, "materialized", lambda df, name: written.append(name) or df.localCheckpoint())
        edges = spark.createDataFrame([*rows, (None, 3), (4, 4)], "src long, dst long")
        near = collections.defaultdict(set)
        for a, b in rows:
            if a != b:
                near[a].add(b), near[b].add(a)
        want = {(a, b, c) for a in near for b in near[a] if a < b for c in near[a] & near[b] if b < c}
        found = [tuple(r) for r in cycles.triangles(edges).collect()]
        assert sorted(found) == sorted(want) and len(written) == tables_written
        counts = collections.Counter(x for t in want for x in t)
        assert {r["node"]: r["n"] for r in cycles.triangle_counts(edges).collect()} == counts


def test_versions_are_read_without_grouping(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, p string")
    first = Versions(rows((1, "a"), (2, "b"), (3, "c")))
    table = first.put(rows((2, "x"), (4, "d"))).drop(rows((4, ""), (1, ""))).put(rows((1, "y"), (5, "e")))
    read = lambda n: sorted(map(tuple, table.at(n).collect()))
    assert read(0) == [(1, "a"), (2, "b"), (3, "c")] and read(1) == [(1, "a"), (2, "x"), (3, "c"), (4, "d")]
    assert read(2) == [(2, "x"), (3, "c")] and read(None) == [(1, "y"), (2, "x"), (3, "c"), (5, "e")]
    # A struct's maximum is no hash aggregate: all rows were sorted twice.
    assert "Aggregate" not in table.at()._jdf.queryExecution().executedPlan().toString()
