"""Whole-pattern writes over versions of a graph, against dictionaries."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.versions import End, Graph, Pattern, Versions, create, delete_edges, detach_delete, merge

LIKES = Pattern(End("P", {"name": "x"}), "LIKES", End("P", {"name": "y"}))


def graph(spark):
    nodes = spark.createDataFrame([(3, "a", 1), (5, "b", 2), (9, "a", 3)], "id long, name string, age int")
    edges = spark.createDataFrame([(2, 3, 5, 1, "old")], "id long, src long, dst long, n int, how string")
    return Graph({"P": Versions(nodes)}, {"LIKES": Versions(edges)})


def test_merge_of_whole_patterns(spark):
    rng = random.Random(5)
    g = graph(spark)
    nodes, edges = {3: ("a", 1), 5: ("b", 2), 9: ("a", 3)}, {2: (3, 5, 1, "old")}
    for round_ in range(3):
        batch = [(rng.choice("abcd"), rng.choice("abc"), rng.randint(1, 9)) for _ in range(7)] + [(None, "a", 1), ("a", None, 2)]
        g = merge(g, spark.createDataFrame(batch, "x string, y string, k int"), LIKES, {"a.age": F.lit(round_), "r.n": F.col("k"), "r.how": F.lit("new")}, {"r.n": F.col("r__n") + F.col("k")})
        wanted = {}
        for x, y, k in batch:
            if x and y:
                wanted[x, y] = min(k, wanted.get((x, y), 99))
        before = dict(edges)
        missing = []
        for (x, y), k in sorted(wanted.items()):
            met = [i for i, (s, t, *_) in before.items() if nodes[s][0] == x and nodes[t][0] == y]
            for i in met:
                edges[i] = (*before[i][:2], before[i][2] + k, before[i][3])
            if not met:
                missing.append((x, y, k))
        top, last = max(nodes) + 1, max(edges) + 1
        for i, (x, y, k) in enumerate(missing):
            nodes[top + i], nodes[top + len(missing) + i] = (x, round_), (y, None)
            edges[last + i] = (top + i, top + len(missing) + i, k, "new")
        assert {r.id: (r.name, r.age) for r in g.nodes["P"].at().collect()} == nodes
        assert {r.id: (r.src, r.dst, r.n, r.how) for r in g.edges["LIKES"].at().collect()} == edges
    first = g.edges["LIKES"].at(0).collect()
    assert [tuple(r) for r in first] == [(2, 3, 5, 1, "old")]
    gone = [i for i, e in edges.items() if e[2] % 2]
    g = delete_edges(g, "LIKES", spark.createDataFrame([(i,) for i in gone] * 2, "id long"))
    assert {r.id for r in g.edges["LIKES"].at().collect()} == set(edges) - set(gone)
    assert {r.id for r in g.edges["LIKES"].compacted().at().collect()} == set(edges) - set(gone) and g.edges["LIKES"].compacted().version == 0
    g = detach_delete(g, "P", spark.createDataFrame([(3,), (11,)], "id long"), {"LIKES": ("P", "P")})
    assert {r.id for r in g.nodes["P"].at().collect()} == set(nodes) - {3, 11}
    left = {r.id for r in g.edges["LIKES"].at().collect()}
    assert left == {i for i, e in edges.items() if i not in gone and not {3, 11} & set(e[:2])}
    g = merge(g, spark.createDataFrame([("z", "z", 1)], "x string, y string, k int"), LIKES)
    assert max(r.id for r in g.edges["LIKES"].at().collect()) == max(edges) + 1


def test_bound_ends_create_and_empty(spark):
    g = graph(spark)
    rows = spark.createDataFrame([(3, "q", 7), (3, "q", 7), (5, "b", 8)], "who long, y string, k int")
    bound = Pattern(End("P", bound="who"), "LIKES", End("P", {"name": "y"}), {"n": "k"})
    made = merge(g, rows, bound)
    assert {(r.src, r.dst, r.n) for r in made.edges["LIKES"].at().collect()} == {(3, 5, 1), (3, 10, 7), (5, 11, 8)}
    again = merge(made, rows, bound)
    assert again.edges["LIKES"].at().count() == 3 and again.nodes["P"].at().count() == 5
    each = create(g, rows, bound, {"r.how": F.lit("c"), "b.age": F.col("k")})
    assert sorted((r.id, r.src, r.dst, r.n, r.how) for r in each.edges["LIKES"].at().where("how = 'c'").collect())[0][0] == 3
    assert each.edges["LIKES"].at().count() == 4 and {r.age for r in each.nodes["P"].at().where("id > 9").collect()} == {7, 8}
    none = merge(g, rows.limit(0), bound)
    assert none.edges["LIKES"].at().count() == 1 and none.nodes["P"].at().count() == 3
    with pytest.raises(ValueError):
        merge(g, rows, bound, on_match={"a.age": F.lit(1)})
