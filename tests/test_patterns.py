"""Relationship uniqueness, paths, clauses and labels of patterns on a small graph, held against loops."""

import importlib.util
import random
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scalar as S
from weftgraph.operators import cycles, paths, vector, writes
from weftgraph.operators.counting import Hop, times
from weftgraph.operators.match import start, v
from weftgraph.operators.procedures import call_procedure, procedures, register
from weftgraph.operators.vector_index import build_index
from weftgraph.plans.lineage import materialized, remove_table
from weftgraph.sources.catalog import GraphCatalog
from weftgraph.sources.sinks import write_nodes

KNOWS = [(1, 2), (2, 3), (3, 1), (1, 2), (3, 3)]
HOME = {1: 10, 2: 10, 3: 11, 4: None}


@pytest.fixture(scope="module")
def g(spark):
    g = GraphCatalog()
    g.add_nodes("City", spark.createDataFrame([(10, "x"), (11, "y")], "city long, name string"), "city", labels=("Place",))
    g.add_nodes("Person", spark.createDataFrame([(i, c, f"p{i}" if i > 1 else None) for i, c in HOME.items()], "person long, home long, nick string"), "person", labels=("Being",))
    g.add_nodes("Dog", spark.createDataFrame([(7,)], "dog long"), "dog", labels=("Being",))
    g.add_foreign_key("LIVES_IN", "Person", "City", "home", on="source")
    g.add_edges("KNOWS", spark.createDataFrame([(i, *e) for i, e in enumerate(KNOWS)], "n long, a long, b long"), "Person", "Person", "a", "b", key=("n",))
    g.add_edges("BORN_IN", spark.createDataFrame([(1, 11)], "p long, c long"), "Person", "City", "p", "c")
    g.add_edges("OWNS", spark.createDataFrame([(1, 7), (2, 7)], "p long, d long"), "Person", "Dog", "p", "d")
    return g


def test_relationships_differ(g):
    homes = Counter((HOME[a], a, b) for a in HOME for b in HOME if a != b and HOME[a] and HOME[a] == HOME[b])
    m = start(g, "c", "City").into("c", "LIVES_IN", "a").into("c", "LIVES_IN", "b")
    assert Counter(map(tuple, m.returns(c=v("c.id"), a=v("a.id"), b=v("b.id")).collect())) == homes
    assert start(g, "a", "Person").out("a", "LIVES_IN", "c").into("c", "LIVES_IN", "a").df.count() == 0
    pairs = Counter((x[0], x[1], y[1]) for i, x in enumerate(KNOWS) for j, y in enumerate(KNOWS) if i != j and x[0] == y[0])
    chain = start(g, "a", "Person").out("a", "KNOWS", "b").out("a", "KNOWS", "c")
    comma = start(g, "a", "Person").out("a", "KNOWS", "b").also(start(g, "a", "Person").out("a", "KNOWS", "c"))
    for m in (chain, comma):
        assert Counter(map(tuple, m.returns(a=v("a.id"), b=v("b.id"), c=v("c.id")).collect())) == pairs
    free = start(g, "a", "Person").out("a", "KNOWS", "b").clause().out("a", "KNOWS", "c")
    assert free.df.count() == sum(x[0] == y[0] for x in KNOWS for y in KNOWS)


def test_optional_then_hops(g):
    m = start(g, "a", "Person").out("a", "KNOWS", "b").optional("b", lambda x: x.out("b", "KNOWS", "c")).out("b", "KNOWS", "d")
    # What follows an optional part is another MATCH, whose relationships may be those of the first.
    want = Counter((x, y, z, w) for x, y in KNOWS for p, z in KNOWS if p == y for q, w in KNOWS if q == y)
    assert Counter(map(tuple, m.returns(a=v("a.id"), b=v("b.id"), c=v("c.id"), d=v("d.id")).collect())) == want


def _all_pairs(g):
    """Every (a, b) of persons, with their nicks."""
    return start(g, "a", "Person").part("b", "Person", on=F.lit(True))


def test_sub_patterns_of_two_variables(g):
    knows, pairs = Counter(KNOWS), [(a, b) for a in HOME for b in HOME]
    hop = lambda x: x.out("a", "KNOWS", "b")
    ids = lambda rows, **more: Counter(map(tuple, rows.returns(a=v("a.id"), b=v("b.id"), **more).collect()))
    assert ids(_all_pairs(g).exists("a", hop)) == Counter(set(KNOWS))
    assert ids(_all_pairs(g).not_exists("a", hop)) == Counter(p for p in pairs if p not in knows)
    assert ids(_all_pairs(g).exists_flag("a", hop, "f"), f=F.col("f")) == Counter((*p, p in knows) for p in pairs)
    assert ids(_all_pairs(g).count_of("a", hop, "n"), n=F.col("n")) == Counter((*p, knows[p]) for p in pairs)
    assert ids(_all_pairs(g).call("a", hop)) == knows
    assert ids(_all_pairs(g).call("a", hop, n=(F.count("*"), F.lit(0))), n=F.col("n")) == Counter((*p, knows[p]) for p in pairs)
    two = lambda x: x.out("a", "KNOWS", "m").out("m", "KNOWS", "b")
    mids = Counter((a, b, m) for i, (a, m) in enumerate(KNOWS) for j, (n, b) in enumerate(KNOWS) if n == m and i != j)
    assert ids(_all_pairs(g).optional("a", two), m=v("m.id")) == mids + Counter((*p, None) for p in pairs if not any(p == x[:2] for x in mids))
    found = (F.array_sort(F.collect_list("m__id")), F.array().cast("array<bigint>"))
    got = _all_pairs(g).aggregate("a", two, found=found).returns(a=v("a.id"), b=v("b.id"), n=F.col("found")).collect()
    assert {(r.a, r.b): r.n for r in got} == {p: sorted(x[2] for x in mids.elements() if x[:2] == p) for p in pairs}


def test_sub_patterns_over_outer_properties(g):
    """Conditions on outer nodes, items of WITH and relationships; nulls among them; repeated outer rows."""
    rows = start(g, "a", "Person").optional("a", lambda x: x.out("a", "LIVES_IN", "c"))
    neighbour = lambda x: x.out("a", "KNOWS", "k").where(v("k.home") == v("c.id"))
    want = {a: HOME[a] is not None and any(HOME[y] == HOME[a] for x, y in KNOWS if x == a) for a in HOME}
    assert {r.a for r in rows.exists("a", neighbour).returns(a=v("a.id")).collect()} == {a for a, w in want.items() if w}
    homeless = lambda x: x.out("a", "KNOWS", "k").where(v("c.id").isNull() | (v("k.home") != v("c.id")))
    want = {a: sum(HOME[a] is None or HOME[y] != HOME[a] for x, y in KNOWS if x == a) for a in HOME}
    assert {r.a: r.n for r in rows.count_of("a", homeless, "n").returns(a=v("a.id"), n=F.col("n")).collect()} == want
    twice = start(g, "a", "Person").unwind(F.array(F.lit(1), F.lit(2), F.lit(2)), "x")
    later = lambda p: p.out("a", "KNOWS", "b").where(v("b.id") >= F.col("x"))
    got = Counter((r.a, r.x, r.n) for r in twice.count_of("a", later, "n").returns(a=v("a.id"), x=F.col("x"), n=F.col("n")).collect())
    assert got == Counter((a, x, sum(p == a and q >= x for p, q in KNOWS)) for a in HOME for x in (1, 2, 2))
    named = start(g, "a", "Person").out("a", "KNOWS", "b", rel="r")
    parallel = named.count_of("a", lambda x: x.out("a", "KNOWS", "b", rel="s").where(v("s.eid") != v("r.eid")), "n")
    assert Counter((r.a, r.b, r.n) for r in parallel.returns(a=v("a.id"), b=v("b.id"), n=F.col("n")).collect()) == Counter((*e, KNOWS.count(e) - 1) for e in KNOWS)
    nested = start(g, "a", "Person").out("a", "KNOWS", "b").exists("b", lambda x: x.out("b", "KNOWS", "c").exists("c", lambda y: y.out("c", "KNOWS", "a")))
    want = Counter((x, y) for x, y in KNOWS if any(p == y and (q, x) in KNOWS for p, q in KNOWS))
    assert Counter(map(tuple, nested.returns(a=v("a.id"), b=v("b.id")).collect())) == want
    filtered = start(g, "a", "Person").where(v("a.id") < 3).exists("a", lambda x: x.out("a", "KNOWS", "b").out("b", "KNOWS", "c").where(v("c.id") == 3))
    assert {r.a for r in filtered.returns(a=v("a.id")).collect()} == {1, 2}
    with pytest.raises(ValueError, match="again"):
        named.optional("a", lambda x: x.out("a", "KNOWS", "z", rel="r"))
    with pytest.raises(ValueError, match="bound already"):
        named.part("b", "Person", on=F.lit(True))


def test_optional_begins_another_match(g):
    m = start(g, "a", "Person").out("a", "KNOWS", "b").optional("b", lambda x: x.out("b", "KNOWS", "c")).out("a", "KNOWS", "d")
    want = Counter((x, y, z, w) for x, y in KNOWS for p, z in KNOWS if p == y for q, w in KNOWS if q == x)
    assert Counter(map(tuple, m.returns(a=v("a.id"), b=v("b.id"), c=v("c.id"), d=v("d.id")).collect())) == want


def test_hops_from_several_labels(g):
    beings = start(g, "x", "Being")
    assert Counter(r.c for r in beings.out("x", "LIVES_IN", "c").returns(c=v("c.id")).collect()) == Counter(c for c in HOME.values() if c)
    found = beings.optional("x", lambda m: m.into("x", "OWNS", "p")).returns(label=v("x.label"), id=v("x.id"), p=v("p.id")).collect()
    assert {(r.label, r.id, r.p) for r in found} == {*(("Person", i, None) for i in HOME), ("Dog", 7, 1), ("Dog", 7, 2)}
    after = start(g, "a", "Person").any("a", "x").into("x", "OWNS", "o")
    assert Counter((r.a, r.o) for r in after.returns(a=v("a.id"), o=v("o.id")).collect()) == Counter({(1, 2): 1, (2, 1): 1})
    onward = start(g, "a", "Person").any("a", "x").clause().any("x", "y")
    assert onward.df.count() == sum(len([1 for p, _ in KNOWS if p == b]) + bool(HOME[b]) + (b == 1) + (b in (1, 2)) for _, b in KNOWS)


def test_equal_rows_of_an_edge_table(spark, tmp_path):
    spark.createDataFrame([(1, 2), (1, 2), (2, 1)], "a long, b long").coalesce(1).write.parquet(str(tmp_path / "e"))
    g = GraphCatalog().add_nodes("N", spark.createDataFrame([(1,), (2,)], "n long"), "n")
    g.add_edges("ONE", lambda: spark.read.parquet(str(tmp_path / "e")), "N", "N", "a", "b")
    g.add_edges("EACH", lambda: spark.read.parquet(str(tmp_path / "e")), "N", "N", "a", "b", by_place=True)
    for type_, once, twice in (("ONE", 2, 0), ("EACH", 3, 2)):
        m = start(g, "x", "N").out("x", type_, "y")
        assert m.df.count() == once and m.out("x", type_, "z").df.count() == twice


@pytest.mark.parametrize("least,most", [(1, 3), (2, 2)])
def test_path_hop(g, least, most):
    def walks(trail, node):
        if least <= len(trail) <= most:
            yield (KNOWS[trail[0]][0], node, len(trail), tuple([KNOWS[trail[0]][0], *[KNOWS[t][1] for t in trail]]))
        if len(trail) < most:
            for i, (x, y) in enumerate(KNOWS):
                if x == node and i not in trail:
                    yield from walks([*trail, i], y)

    want = Counter(w for i, (_, y) in enumerate(KNOWS) for w in walks([i], y))
    out = start(g, "a", "Person").path("a", "KNOWS", "b", least, most, "p").returns(a=v("a.id"), b=v("b.id"), n=v("p.length"), nodes=v("p.nodes"))
    assert Counter((r.a, r.b, r.n, tuple(r.nodes)) for r in out.collect()) == want


def test_alternatives_and_labels(g):
    m = start(g, "a", "Person").any("a", "x", ["LIVES_IN", "BORN_IN"], rel="r")
    assert {(r.a, r.t, r.name) for r in m.returns(a=v("a.id"), t=m.type_of("r"), name=v("x.name")).collect()} == {(1, "LIVES_IN", "x"), (2, "LIVES_IN", "x"), (3, "LIVES_IN", "y"), (1, "BORN_IN", "y")}
    m = start(g, "a", "Person").any("a", "x")
    assert Counter(r.label for r in m.returns(label=v("x.label")).collect()) == {"Person": 5, "City": 4, "Dog": 2}
    assert {(r.label, r.id) for r in start(g, "b", "Being").returns(label=v("b.label"), id=v("b.id")).collect()} == {("Person", 1), ("Person", 2), ("Person", 3), ("Person", 4), ("Dog", 7)}
    m = start(g, "p", "Person:Being")
    assert {r.id: (r.labels, r.keys) for r in m.returns(id=v("p.id"), labels=m.labels_of("p"), keys=m.keys_of("p")).collect()}[1] == (["Person", "Being"], ["person", "home"])
    with pytest.raises(KeyError):
        start(g, "p", "Person:Place")
    nodes, edges = g.fetch(3, 2)
    assert nodes.count() == 3 and edges.count() == 2


def test_clauses(g):
    m = start(g, "a", "Person").call("a", lambda x: x.out("a", "KNOWS", "b"), [F.desc("b__id")], 1)
    assert {(r.a, r.b) for r in m.returns(a=v("a.id"), b=v("b.id")).collect()} == {(1, 2), (2, 3), (3, 3)}
    m = start(g, "a", "Person").out("a", "KNOWS", "b").group("a", n=F.count("*")).order_by(F.desc("n"), F.col("a__id")).skip(1).limit(1)
    assert [(r.a, r.n) for r in m.returns(a=v("a.id"), n=F.col("n")).collect()] == [(3, 2)]


def test_one_search_for_many_targets(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)], "src long, dst long")
    pairs = spark.createDataFrame([(0, 0), (0, 3), (0, 4), (1, 4), (4, 0)], "source long, target long")
    one = {(r.source, r.target): (r.distance, r.path) for r in paths.shortest_paths(edges, pairs, 5).collect()}
    assert one == {(0, 0): (0, [0]), (0, 3): (2, [0, 1, 3]), (0, 4): (3, [0, 1, 3, 4]), (1, 4): (2, [1, 3, 4])}
    every = Counter((r.source, r.target) for r in paths.shortest_paths(edges, pairs, 3, every=True).collect())
    assert every == {(0, 0): 1, (0, 3): 2, (0, 4): 2, (1, 4): 1}


def test_queries_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5) + 1]) for i in range(40)], "id long, e array<float>")
    asked = rows.select(F.col("id").alias("query"), F.col("e").alias("vector"))
    whole = Counter(map(tuple, vector.top_k_join(rows, asked, "id", "e", 3).collect()))
    monkeypatch.setattr(vector, "MOST_QUERIES", 7)
    assert Counter(map(tuple, vector.top_k_join(rows, asked, "id", "e", 3).collect())) == whole and len(whole) == 120


def test_functions(spark):
    row = spark.range(1).select(S.integer_divide(F.lit(2**60 + 1), F.lit(1)).alias("d"), S.integer_divide(F.lit(1), F.lit(0)).alias("z"), S.matches(F.lit("ab\n"), "ab").alias("m")).first()
    assert (row.d, row.z, row.m) == (2**60 + 1, None, False)


def test_removed_table(spark):
    table = materialized(spark.range(3), "gone")
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists() and table.count() == 3
    remove_table(table)
    assert not folder.exists()


def test_rest_works_without_the_text_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "weftgraph", tmp_path / "weftgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "weftgraph/llm/__pycache__").mkdir(parents=True)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True, timeout=60)
    assert importlib.util.find_spec("weftgraph.operators") is not None


def _random_graph(spark, seed):
    rnd = random.Random(seed)
    g = GraphCatalog()
    g.add_nodes("A", spark.createDataFrame([(i, i % 3) for i in range(6)], "a long, x long"), "a")
    g.add_nodes("B", spark.createDataFrame([(i, i % 2) for i in range(5)], "b long, y long"), "b")
    for type_, n in (("T", 22), ("U", 9)):
        rows = [(i, rnd.randrange(7), rnd.randrange(6), rnd.randrange(4)) for i in range(n)]
        g.add_edges(type_, spark.createDataFrame(rows, "k long, p long, q long, w long"), "A", "B", "p", "q", key=("k",))
    return g


def test_counted_patterns(spark):
    """Counts without pairs equal those of hops: siblings, three alike, conditions, and there and back."""
    g = _random_graph(spark, 4)
    heavy = v("rel.w") > 1
    cases = [
        ([Hop("T", "p"), Hop("T", "q")], lambda m: m.out("a", "T", "p").out("a", "T", "q")),
        ([Hop("T", "p", where=heavy), Hop("T", "q"), Hop("T", "r")], lambda m: m.out("a", "T", "p", rel="rel").where(heavy).out("a", "T", "q").out("a", "T", "r")),
        ([Hop("T", "p", where=heavy), Hop("T", "q", where=v("q.y") == 1), Hop("U", "u")], lambda m: m.out("a", "T", "p", rel="rel").where(heavy).out("a", "T", "q").where(v("q.y") == 1).out("a", "U", "u")),
        ([Hop("T", "p", then=(Hop("T", "b", forward=False),))], lambda m: m.out("a", "T", "p").into("p", "T", "b")),
        ([Hop("T", "p", then=(Hop("T", "b", forward=False, where=v("b.x") > 0), Hop("T", "c", forward=False)))], lambda m: m.out("a", "T", "p").into("p", "T", "b").where(v("b.x") > 0).into("p", "T", "c")),
        ([Hop("T", "p", then=(Hop("U", "b", forward=False),)), Hop("T", "q")], lambda m: m.out("a", "T", "p").into("p", "U", "b").out("a", "T", "q")),
    ]
    for hops, walk in cases:
        want = Counter({r.id: r.n for r in walk(start(g, "a", "A")).returns_grouped({"id": v("a.id")}, n=F.count("*")).collect()})
        got = times(start(g, "a", "A"), "a", hops, "n")
        assert Counter({r.id: r.n for r in got.returns(id=v("a.id"), n=F.col("n")).collect()}) == want and want
    for hops in ([Hop("T", "p", then=(Hop("U", "b", forward=False, then=(Hop("T", "c"),)),))], [Hop("U", "u", then=(Hop("T", "z", forward=False),)), Hop("T", "q")]):
        with pytest.raises(ValueError, match="twice"):
            times(start(g, "a", "A"), "a", hops, "n")
    with pytest.raises(ValueError, match="already"):
        times(start(g, "a", "A").out("a", "T", "p"), "a", [Hop("T", "q")], "n")
    with pytest.raises(ValueError, match="does not start"):
        times(start(g, "b", "B"), "b", [Hop("T", "q")], "n")


def test_keys_of_any_type(spark):
    people = spark.createDataFrame([("ann", 1, "x"), ("bob", 1, "y"), ("ann", 2, "z"), (None, 3, "no node")], "name string, n int, tag string")
    towns = spark.createDataFrame([(7.5,), (1.25,)], "height double")
    knows = [("ann", 1, "bob", 1), ("bob", 1, "ann", 2), ("ann", 2, "cid", 9), (None, 1, "ann", 1), ("ann", 1, "bob", 1)]
    g = GraphCatalog().add_keyed_nodes("P", people, ("name", "n")).add_keyed_nodes("T", towns, ("height",))
    g.add_keyed_edges("K", spark.createDataFrame(knows, "a string, i int, b string, j int"), "P", "P", ("a", "i"), ("b", "j"))
    g.add_keyed_edges("IN", spark.createDataFrame([("ann", 1, 7.5), ("ann", 2, 1.25), ("bob", 1, 0.0)], "a string, i int, h double"), "P", "T", ("a", "i"), ("h",))
    assert sorted(r.id for r in start(g, "x", "P").returns(id=v("x.id")).collect()) == [0, 1, 2]
    m = start(g, "x", "P").out("x", "K", "y").out("y", "K", "z").out("z", "IN", "t")
    assert [tuple(r) for r in m.returns(x=v("x.tag"), y=v("y.tag"), z=v("z.tag"), t=v("t.height")).collect()] == [("x", "y", "z", 1.25)]
    assert start(g, "x", "P").path("x", "K", "y", 1, 3, "p").df.count() == 3
    with pytest.raises(KeyError):
        g.add_keyed_nodes("Q", spark.range(2), ("id",))


def test_whole_nodes_and_relationships(g):
    m = start(g, "a", "Person").path("a", "KNOWS", "b", 0, 2, "p").nodes_of("p", "ns").relationships_of("p", "rs")
    rows = m.returns(ids=v("p.nodes"), ns=F.col("ns"), rs=F.col("rs")).collect()
    assert len(rows) == len(HOME) + len(KNOWS) + sum(x[1] == y[0] and i != j for i, x in enumerate(KNOWS) for j, y in enumerate(KNOWS))
    for r in rows:
        assert [(n.id, n.home) for n in r.ns] == [(i, HOME[i]) for i in r.ids]
        assert [(e.src, e.dst) for e in r.rs] == list(zip(r.ids, r.ids[1:])) and all(KNOWS[e.n] == (e.src, e.dst) for e in r.rs)
    m = start(g, "a", "Person").out("a", "KNOWS", "b", rel="r").end_of("r", "start", "s").end_of("r", "end", "e")
    assert all(r.a == r.s and r.b == r.e and r.h == HOME[r.b] for r in m.returns(a=v("a.id"), b=v("b.id"), s=v("s.id"), e=v("e.id"), h=v("e.home")).collect())
    assert {r.x for r in start(g, "x", "Being").returns(x=start(g, "x", "Being").element_id("x")).collect()} == {"Person:1", "Person:2", "Person:3", "Person:4", "Dog:7"}
    every = start(g, "a", "Person").out("a", "LIVES_IN", "c").unwind(F.array(F.lit(1)), "k").returns_all()
    assert every.columns == ["a", "c", "k"] and {(r.a.id, r.c.name, r.k) for r in every.collect()} == {(1, "x", 1), (2, "x", 1), (3, "y", 1)}


def test_triangles(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(16), rnd.randrange(16)) for _ in range(60)] + [(99, i) for i in range(16)] + [(None, 1), (2, None), (5, 5)]
    near = {frozenset(e) for e in rows if None not in e and e[0] != e[1]}
    nodes = sorted({x for e in near for x in e})
    want = {(a, b, c) for a in nodes for b in nodes if a < b for c in nodes if b < c and {frozenset((a, b)), frozenset((b, c)), frozenset((a, c))} <= near}
    edges = spark.createDataFrame(rows, "src long, dst long")
    assert Counter(map(tuple, cycles.triangles(edges).collect())) == Counter(want) and want
    ahead = Counter(r.u for r in cycles.oriented(edges).collect())
    assert max(ahead.values()) <= (2 * len(near)) ** 0.5 < 17
    assert {r.node: r.n for r in cycles.triangle_counts(edges).collect()} == Counter(x for t in want for x in t)
    assert cycles.triangles(edges.limit(0)).collect() == []


def test_closing_hops(g):
    m = start(g, "a", "Person").out("a", "KNOWS", "b").out("b", "KNOWS", "c").out("c", "KNOWS", "a")
    want = Counter((x[0], y[0], z[0]) for i, x in enumerate(KNOWS) for j, y in enumerate(KNOWS) for k, z in enumerate(KNOWS) if len({i, j, k}) == 3 and x[1] == y[0] and y[1] == z[0] and z[1] == x[0])
    assert Counter(map(tuple, m.returns(a=v("a.id"), b=v("b.id"), c=v("c.id")).collect())) == want
    m = start(g, "a", "Person").out("a", "KNOWS", "b").out("a", "LIVES_IN", "c").out("b", "LIVES_IN", "c")
    assert Counter(map(tuple, m.returns(a=v("a.id"), b=v("b.id")).collect())) == Counter(e for e in KNOWS if HOME[e[0]] == HOME[e[1]] and e[0] != e[1])
    m = start(g, "c", "City").into("c", "LIVES_IN", "a").out("a", "KNOWS", "b").into("c", "LIVES_IN", "b")
    assert Counter(map(tuple, m.returns(a=v("a.id"), b=v("b.id")).collect())) == Counter(e for e in KNOWS if HOME[e[0]] == HOME[e[1]] and e[0] != e[1])


def test_procedures(g, spark):
    assert {(r.label, r.n) for r in call_procedure(g, "db.labels").collect()} == {("City", 2), ("Place", 2), ("Person", 4), ("Dog", 1), ("Being", 5)}
    assert {r.t: r.n for r in call_procedure(g, "db.relationshipTypes", t="relationshipType", n="n").collect()} == {"KNOWS": 5, "LIVES_IN": 3, "BORN_IN": 1, "OWNS": 2}
    assert ("nick", "Person", 3) in {tuple(r) for r in call_procedure(g, "db.propertyKeys").collect()}
    index = build_index(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, e array<float>"), "id", "e")
    asked = spark.createDataFrame([(9, [2.0, 0.1])], "query long, vector array<float>")
    assert [tuple(r) for r in call_procedure(g, "db.index.vector.queryNodes", index, 1, asked, q="query", node="node").collect()] == [(9, 1)]
    with pytest.raises(KeyError, match="did you mean db.labels"):
        call_procedure(g, "db.label")
    with pytest.raises(KeyError, match="does not yield"):
        call_procedure(g, "db.labels", x="y")
    with pytest.raises(ValueError, match="already"):
        register("db.labels", "label")(lambda graph: None)
    assert "db.propertyKeys" in procedures()


def test_temporal_constructors(spark):
    texts = ["P1Y2M10DT2H30M1.5S", "-P1D", "P2W", "PT0S", "PT", "P", "1D", "P1YT", None, "PT-5M"]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(S.duration_from(F.col("t")).cast("string").alias("x")).collect()]
    assert got == ["1 years 2 months 10 days 2 hours 30 minutes 1.5 seconds", "-1 days", "14 days", "0 seconds", None, None, None, None, None, "-5 minutes"]
    row = spark.range(1).select(
        S.date_of({"year": 2024}).alias("y"), S.date_of({"year": 2024, "month": 2, "day": 30}).alias("no"), S.date_of({"year": 2021, "week": 1, "dayOfWeek": 7}).alias("w"), S.date_of({"year": 2024, "ordinalDay": 60}).alias("o"),
        S.datetime_of({"year": 2024, "month": 5, "hour": 3, "millisecond": 250}).cast("string").alias("t"), (S.time_of({"hour": 2}) < S.time_of_day(F.lit("2020-01-01 03:00:00").cast("timestamp"))).alias("less"),
        S.duration_of({"years": 1, "minutes": 2}).cast("string").alias("d"),
    ).first()
    assert (str(row.y), row.no, str(row.w), str(row.o), row.t, row.less, row.d) == ("2024-01-01", None, "2021-01-10", "2024-02-29", "2024-05-01 03:00:00.25", True, "1 years 2 minutes")


def test_bulk_writes_and_files(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, "x")], "src long, dst long, p string")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    made = writes.create_edges(edges, spark.createDataFrame([(2, 3, "y"), (2, 9, "z"), (8, 3, "z")], "src long, dst long, p string"), nodes, nodes)
    assert {tuple(r) for r in made.collect()} == {(1, 2, "x"), (2, 3, "y")}
    labels = spark.range(1).select(writes.add_label(F.array(F.lit("A")), "B").alias("more"), writes.add_label(F.array(F.lit("A")), "A").alias("same"), writes.remove_label(F.array(F.lit("A"), F.lit("B")), "A").alias("less")).first()
    assert (labels.more, labels.same, labels.less) == (["A", "B"], ["A"], ["B"])
    assert Counter(r.x for r in writes.for_each(nodes, F.sequence(F.lit(1), F.col("id")), "x").collect()) == Counter({1: 3, 2: 2, 3: 1})
    write_nodes(nodes.withColumn("x", F.lit(1)), str(tmp_path / "n"), partition_by=["id"])
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "n")).collect()) == [1, 2, 3]


def test_text_package_that_cannot_be_imported(tmp_path):
    """The graph queries stay where a module of the text operators is missing."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "weftgraph", tmp_path / "weftgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "weftgraph/llm").mkdir()
    (tmp_path / "weftgraph/llm/__init__.py").write_text("import a_module_that_is_nowhere\n")
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(n.startswith('op1_') for n in q) and e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True, timeout=60, capture_output=True, text=True)
    assert "a_module_that_is_nowhere" in done.stderr
