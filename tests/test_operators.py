"""Operators on micro graphs, against brute force and by hand."""

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scalar as S
from weftgraph.operators import paths, schema, text, vector, writes
from weftgraph.operators.match import start, v
from weftgraph.sources.catalog import GraphCatalog
from weftgraph.sources.sinks import format_records

EDGES = [(1, 2), (2, 3), (3, 4), (4, 1), (2, 2), (1, 3), (1, 3), (5, 6)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(EDGES)], "src long, dst long, eid long")


def ids(spark, values):
    return spark.createDataFrame([(x,) for x in values], "id long")


def trails(start_at, least, most):
    out = []

    def walk(node, used):
        if len(used) >= least:
            out.append((start_at, node, len(used)))
        if len(used) < most:
            for i, (a, b) in enumerate(EDGES):
                if a == node and i not in used:
                    walk(b, [*used, i])

    walk(start_at, [])
    return sorted(out)


@pytest.mark.parametrize("least,most", [(0, 2), (1, 3), (2, 2)])
def test_var_length(spark, edges, least, most):
    found = paths.var_length(edges, ids(spark, [1, 5]), least, most).select("start", "end", "hops").collect()
    assert sorted(map(tuple, found)) == sorted(trails(1, least, most) + trails(5, least, most))


def distances(start_at):
    dist, frontier = {start_at: 0}, [start_at]
    while frontier:
        nxt = []
        for x in frontier:
            for a, b in EDGES:
                if a == x and b not in dist:
                    dist[b] = dist[x] + 1
                    nxt.append(b)
        frontier = nxt
    return dist


def test_reachable_and_shortest(spark, edges):
    found = {(r.seed, r.node): r.distance for r in paths.reachable(edges, ids(spark, [1, 5]), 10).collect()}
    assert found == {(s, n): d for s in (1, 5) for n, d in distances(s).items()}
    pairs = spark.createDataFrame(list(itertools.product(range(1, 7), repeat=2)), "source long, target long")
    short = {(r.source, r.target): r.distance for r in paths.shortest_paths(edges, pairs, 6).collect()}
    assert short == {(s, t): d for s in range(1, 7) for t, d in distances(s).items()}
    there = {(r.source, r.target): r.connected for r in paths.path_exists(edges, pairs, 6).collect()}
    assert there == {(s, t): t in distances(s) for s in range(1, 7) for t in range(1, 7)}


def test_diamond_has_two_shortest(spark):
    e = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (2, 4, 2), (3, 4, 3)], "src long, dst long, eid long")
    pair = spark.createDataFrame([(1, 4)], "source long, target long")
    assert paths.shortest_paths(e, pair, 3, every=True).count() == 2
    assert [r.path for r in paths.shortest_paths(e, pair, 3).collect()] == [[1, 2, 4]]


def test_degree_and_neighbours(spark, edges):
    found = {r.id: r.degree for r in paths.degrees(edges, ids(spark, [1, 2, 9])).collect()}
    assert found == {1: 4, 2: 3, 9: 0}
    assert sorted(r.neighbour for r in paths.neighbours(edges, ids(spark, [2])).collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        paths.neighbours(edges, ids(spark, [2]), "up")


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long, eid long")
    assert paths.reachable(none, ids(spark, [1]), 3).count() == 1
    assert paths.var_length(none, ids(spark, [1]), 1, 2).count() == 0


@pytest.fixture(scope="module")
def people(spark):
    g = GraphCatalog()
    g.add_nodes("Person", spark.createDataFrame([(1, "Ann"), (2, "Bob"), (3, None)], "id long, name string"), "id")
    g.add_nodes("Firm", spark.createDataFrame([(7, "Acme")], "id long, name string"), "id")
    g.add_edges("KNOWS", spark.createDataFrame([(1, 2), (2, 2), (2, 3)], "a long, b long"), "Person", "Person", "a", "b")
    g.add_edges("WORKS", spark.createDataFrame([(1, 7)], "p long, f long"), "Person", "Firm", "p", "f")
    return g


def test_match(people):
    m = start(people, "a", "Person")
    assert sorted((r.a, r.b) for r in m.both("a", "KNOWS", "b").returns(a=v("a.id"), b=v("b.id")).collect()) == [(1, 2), (2, 1), (2, 2), (2, 3), (3, 2)]
    optional = m.optional("a", lambda x: x.out("a", "WORKS", "f")).returns(a=v("a.id"), f=v("f.id"))
    assert sorted(map(tuple, optional.collect()), key=str) == [(1, 7), (2, None), (3, None)]
    # The self-loop may not serve as both hops, since relationships are unique in a pattern.
    two = m.out("a", "KNOWS", "b").out("b", "KNOWS", "c").returns(a=v("a.id"), b=v("b.id"), c=v("c.id"))
    assert sorted(map(tuple, two.collect())) == [(1, 2, 2), (1, 2, 3), (2, 2, 3)]
    assert m.out("a", "KNOWS", "a").df.count() == 1
    assert [r.n for r in m.count_of("a", lambda x: x.out("a", "KNOWS", "b"), "n").df.orderBy("a__id").select("n").collect()] == [1, 2, 0]
    with pytest.raises(KeyError, match="did you mean KNOWS"):
        m.out("a", "KNOW", "b")
    with pytest.raises(ValueError):
        m.part("f", "Firm")


def test_writes(spark):
    nodes = spark.createDataFrame([(1, "x"), (2, "y")], "id long, tag string")
    rows = spark.createDataFrame([(2, "z"), (3, "b"), (3, "a")], "id long, tag string")
    assert sorted(map(tuple, writes.merge_nodes(nodes, rows, ["id"], ["tag"]).collect())) == [(1, "x"), (2, "z"), (3, "a")]
    replaced = writes.set_properties(nodes, F.col("id") == 1, replace=True, key="id")
    assert sorted(map(tuple, replaced.collect()), key=str) == [(1, None), (2, "y")]
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    assert [tuple(r) for r in writes.detach(e, ids(spark, [2])).collect()] == [(3, 4)]
    assert writes.attached(e, ids(spark, [2])).count() == 2


def test_lists(spark):
    row = spark.range(1).select(F.array(F.lit(1), F.lit(2), F.lit(3)).alias("xs"), F.array().cast("array<int>").alias("none"))
    one = lambda c: row.select(c.alias("x")).first().x
    xs, none = F.col("xs"), F.col("none")
    assert one(S.item(xs, -1)) == 3 and one(S.item(xs, 5)) is None and one(S.item(none, -1)) is None
    assert one(S.slice_list(xs, 1)) == [2, 3] and one(S.slice_list(xs, -2, -1)) == [2] and one(S.slice_list(xs, 2, 1)) == []
    assert one(S.tail(none)) == [] and one(S.head(none)) is None and one(S.last(none)) is None
    assert one(S.range_list(1, 3)) == [1, 2, 3] and one(S.range_list(3, 1)) == [] and one(S.range_list(3, 1, -1)) == [3, 2, 1]
    assert one(S.to_integer(F.lit("3.7"))) == 3 and one(S.to_integer(F.lit("q"))) is None
    assert one(S.round_half_up(F.lit(-2.5))) == -2.0 and one(S.trim(F.lit("\t a \n"))) == "a"
    assert one(S.in_list(F.lit(9), F.array(F.lit(1), F.lit(None).cast("int")))) is None
    assert one(S.integer_divide(F.lit(-7), F.lit(2))) == -3 and one(S.integer_divide(F.lit(1), F.lit(0))) is None


def test_vector(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "id long, e array<float>")
    assert [r.id for r in vector.top_k(rows, "id", "e", [1.0, 0.1], 2).collect()] == [1, 3]
    asked = rows.where("id = 2").select(F.col("id").alias("query"), F.col("e").alias("vector"))
    assert [r.id for r in vector.top_k_join(rows, asked, "id", "e", 2, "euclidean").orderBy("rank").collect()] == [2, 3]


def test_text(spark):
    assert text.chunk_text("One. Two! Three? Four.", 11, 5) == ["One. Two!", "Two! Three?", "Four."]
    assert text.chunk_text("   ", 10, 2) == []
    df = spark.createDataFrame([(1, "Ann likes Bob. Bob LIKES tea."), (2, None)], "id long, t string")
    found = text.triples(text.relations(df, "id", "t", {"likes": "LIKES"}))
    assert sorted(map(tuple, found.collect())) == [("Ann", "LIKES", "Bob"), ("Bob", "LIKES", "tea")]
    status = text.entity_status(found, spark.createDataFrame([("Bob",)], "name string"))
    assert {r.name: r.found for r in status.collect()} == {"Ann": False, "Bob": True, "tea": False}
    assert {r.chunk for r in text.chunks(df, "id", "t", 16, 0).collect()} == {0, 1}


def test_schema(spark, people):
    d = people.describe(spark)
    merged = schema.schema_merge(d, d)
    assert merged.count() == d.count()
    assert schema.schema_diff(d, d).count() == 0
    assert schema.ddl(d).where("name = 'Firm'").count() == 2


def test_records(spark):
    df = spark.createDataFrame([(1, "a"), (22, None)], "id long, s string")
    assert format_records(df, "markdown").splitlines()[1] == "| -- | - |"
    assert format_records(df, "csv") == "id,s\n1,a\n22,\n"
    assert format_records(df.limit(0), "json") == ""
    with pytest.raises(ValueError):
        format_records(df, "xml")


def test_relations_share_words_of_any_script(spark):
    rows = [(1, "capital of region of France"), (2, "café of Paris, table OF carré; an of of of it"), (3, "Душа\u00a0of мира of"), (4, None)]
    want = set()
    for d, t in rows:
        w = re.findall(r"\w+|[^\w\s]", t or "")
        want |= {(d, a, "OF", b) for a, v, b in zip(w, w[1:], w[2:]) if v.lower() == "of" and a[0].isalpha() and b[0].isalpha()}
    found = text.relations(spark.createDataFrame(rows, "id long, t string"), "id", "t", {"of": "OF"}).collect()
    assert set(map(tuple, found)) == want and len(found) == len(want) == 8


def _shortest(edges, source, target, most):
    """All shortest paths by brute force."""
    level = [[source]]
    for k in range(most + 1):
        hit = [p for p in level if p[-1] == target]
        if hit:
            return sorted({tuple(p) for p in hit})
        level = [[*p, b] for p in level for a, b in set(edges) if a == p[-1] and b not in p]
    return []


def test_searches_from_both_ends(spark):
    import random

    rnd = random.Random(8)
    pairs_of = [(rnd.randrange(14), rnd.randrange(14)) for _ in range(26)] + [(20 + i, 21 + i) for i in range(9)] + [(29, 20), (3, 3), (40, 41), (40, 41)]
    graph = spark.createDataFrame(pairs_of, "src long, dst long")
    asked = [(a, b) for a in (0, 3, 5, 7, 20, 25, 40, 99) for b in (0, 2, 3, 7, 9, 20, 24, 29, 41, 99)] + [(0, 2)] * 2
    pairs = spark.createDataFrame([*asked, (None, 1), (1, None)], "source long, target long")
    for most in (0, 3, 6):
        want = {p: _shortest(pairs_of, *p, most) for p in set(asked)}
        got = collections.defaultdict(list)
        for r in paths.shortest_paths(graph, pairs, most, every=True).collect():
            assert r.distance == len(r.path) - 1
            got[r.source, r.target].append(tuple(r.path))
        assert {p: sorted(x) for p, x in got.items()} == {p: x for p, x in want.items() if x}
        assert {(r.source, r.target): tuple(r.path) for r in paths.shortest_paths(graph, pairs, most).collect()} == {p: x[0] for p, x in want.items() if x}
        assert {(r.source, r.target): (r.distance, r.n) for r in paths.count_shortest_paths(graph, pairs, most).collect()} == {p: (len(x[0]) - 1, len(x)) for p, x in want.items() if x}


def test_closure_by_doubling(spark):
    import random

    rnd = random.Random(2)
    rows = [(rnd.randrange(12), rnd.randrange(12)) for _ in range(14)] + [(100 + i, 101 + i) for i in range(37)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    want = {}
    for a in {x for e in rows for x in e}:
        front, k = {a}, 0
        while front:
            want |= {(a, n): k for n in front}
            front, k = {q for p, q in rows if p in front and (a, q) not in want}, k + 1
    graph = spark.createDataFrame(rows, "src long, dst long")
    assert {(r.seed, r.node): r.distance for r in paths.closure(graph).collect()} == want
    seeds = spark.createDataFrame([(100,), (201,), (999,), (100,)], "id long")
    assert {(r.seed, r.node): r.distance for r in paths.closure(graph, seeds).collect()} == {k: d for k, d in want.items() if k[0] in (100, 201)} | {(999, 999): 0}
    assert paths.closure(graph.where("src < 0")).collect() == []


def test_phrases_of_a_dictionary(spark):
    """Longest names first, from left to right, against a loop; labels that share a name; names that begin alike."""
    import random

    rnd = random.Random(12)
    letters = ["a", "b", "Cé", "d"]
    known = {(rnd.choice("XY"), " ".join(rnd.choice(letters) for _ in range(rnd.randint(1, 4)))) for _ in range(14)} | {("X", "a b"), ("Y", "A  b"), ("Z", "12"), ("Z", None)}
    texts = [(i % 9, "".join(rnd.choice(letters).upper() + rnd.choice([" ", ", ", "\n", " 1 "]) for _ in range(rnd.randint(0, 40)))) for i in range(40)] + [(3, None), (4, ""), (5, "a b"), (5, "a b")]
    split = lambda x: re.findall(r"[^\W\d_]+", (x or "").lower())
    want = collections.Counter()
    for doc, t in texts:
        ws, at = split(t), 0
        while at < len(ws):
            met = [(len(split(n)), label, n) for label, n in known if split(n) and ws[at : at + len(split(n))] == split(n)]
            longest = max((k for k, _, _ in met), default=0)
            want.update((doc, label, n, at) for k, label, n in met if k == longest)
            at += longest or 1
    names = spark.createDataFrame(list(known), "label string, name string")
    df = spark.createDataFrame(texts, "doc long, t string").repartition(3)
    assert collections.Counter(map(tuple, text.phrase_mentions(df, "doc", "t", names).collect())) == want
    assert text.phrase_mentions(df, "doc", "t", names.where("label = 'Z'")).collect() == []
    assert text.phrase_mentions(df.limit(0), "doc", "t", names).collect() == []


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next_row(row, i, x, b)
    return row[-1]


def _next_row(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return out


def test_upsert_of_triples(spark):
    nodes = [(10, "Berlin"), (4, "berlin"), (7, "Hamburg"), (9, "abc"), (12, "Merlin"), (15, None)]
    found = [(1, "Berlin", "of", "hamburk"), (1, "BERLIN", "OF", "Hamburg"), (2, "terlin", "in", "abd"), (2, "Newtown", "in", "newtown"), (3, "", "of", "x"), (3, None, "of", "x"), (4, "Xanadu", "of", "Newtow")]
    names = {x for _, a, _, b in found if a and b for x in (a, b)}
    want = {}
    for key in sorted({n.lower() for n in names}):
        exact = [i for i, n in nodes if n and n.lower() == key]
        near = [i for i, n in nodes if n and len(key) >= text.LEAST_FUZZY and _edit(key, n.lower()) <= 1]
        want[key] = min(exact or near, default=None)
    fresh = iter(range(16, 99))
    placed = {k: (i if i is not None else next(fresh), i is None) for k, i in want.items()}
    df, have = spark.createDataFrame(found, "doc long, subject string, type string, object string"), spark.createDataFrame(nodes, "id long, name string")
    asked = df.selectExpr("explode(array(subject, object)) AS name").where("name != '' AND name != 'x'")
    assert {(r.name, r.id, r.created) for r in text.resolved(asked, have).collect()} == {(n, *placed[n.lower()]) for n in names}
    edges = spark.createDataFrame([(placed["berlin"][0], "OF", placed["hamburg"][0])], "src long, type string, dst long")
    new_nodes, new_edges, mentions = text.upsert_triples(df, have, edges, "doc")
    assert {tuple(r) for r in new_nodes.collect()} == {(i, k) for k, (i, made) in placed.items() if made}
    all_edges = {(placed[a.lower()][0], t.upper(), placed[b.lower()][0]) for _, a, t, b in found if a and b}
    assert {tuple(r) for r in new_edges.collect()} == all_edges - {(4, "OF", 7)}
    assert {tuple(r) for r in mentions.collect()} == {(placed[x.lower()][0], d) for d, a, _, b in found if a and b for x in (a, b)}
    new_nodes, new_edges, mentions = text.upsert_triples(df.limit(0), have.limit(0), edges.limit(0), "doc")
    assert new_nodes.count() == new_edges.count() == mentions.count() == 0
