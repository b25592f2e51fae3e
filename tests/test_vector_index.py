"""The vector index: recall against the exact search, and rows that no index can place."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import vector, vector_index
from weftgraph.operators.vector_index import build_index, lists_to_probe

SCHEMA = "id long, e array<float>"


def rows(n, spread, seed=3, width=16):
    rnd = random.Random(seed)
    middles = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    return [(i, [m + spread * rnd.gauss(0, 1) for m in rnd.choice(middles)]) for i in range(n)]


def asked(df):
    return df.where("id % 50 = 0").select(F.col("id").alias("query"), F.col("e").alias("vector"))


@pytest.mark.parametrize("spread, most_probes", [(0.2, 12), (5.0, 55)])
def test_recall(spark, spread, most_probes):
    df = spark.createDataFrame(rows(3000, spread), SCHEMA).repartition(6)
    index = build_index(df, "id", "e")
    assert sum(len(r.keys) for r in index.lists.collect()) == 3000 and index.probes <= most_probes
    exact = {(r.query, r.id): r.score for r in vector.top_k_join(df, asked(df), "id", "e", 20).collect()}
    found = {(r.query, r.id): r.score for r in index.search(asked(df), 20).collect()}
    assert len(found) == len(exact) == 1200
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact)
    assert all(math.isclose(exact[x], found[x], abs_tol=1e-6) for x in exact.keys() & found.keys())
    every = {(r.query, r.id) for r in index.search(asked(df), 20, probes=len(index.book)).collect()}
    assert every == exact.keys()


def test_one_hot_list_ties_and_bad_rows(spark, monkeypatch):
    """Copies of one vector fill a list many times over; blocks stay small, ties go to the smaller key."""
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 64)
    same = [(1000 + i, [1.0, 2.0, 3.0]) for i in range(700)]
    bad = [(5, None), (6, [1.0, None, 2.0]), (7, [float("nan")] * 3), (8, [0.0] * 3), (9, [1.0]), (10, [])]
    df = spark.createDataFrame(same + bad + [(i, [float(i), 1.0, -1.0]) for i in range(20, 60)] + [(1000, [1.0, 2.0, 3.0])], SCHEMA)
    index = build_index(df, "id", "e")
    stored = index.lists.collect()
    assert sum(len(r.keys) for r in stored) == 741 and max(len(r.keys) for r in stored) <= 64
    queries = spark.createDataFrame([(1, [2.0, 4.0, 6.0]), (1, [2.0, 4.0, 6.0]), (2, None), (3, [0.0] * 3), (4, [1.0])], "query long, vector array<float>")
    got = sorted(index.search(queries, 5).collect(), key=lambda r: r.rank)
    assert [(r.query, r.id, r.score) for r in got] == [(1, 1000, 1.0), (1, 1000, 1.0), (1, 1001, 1.0), (1, 1002, 1.0), (1, 1003, 1.0)]
    assert build_index(df.where("id < 11 AND id != 9"), "id", "e") is None
    assert build_index(df.limit(0), "id", "e") is None


def test_lists_to_probe():
    units = np.eye(8).repeat(3, axis=0)
    assert lists_to_probe(units, np.eye(8)) >= 1
    assert lists_to_probe(units[:1], np.eye(8)[:1]) == 1


def test_blocks_are_not_broadcast(spark):
    """Copies compress to next to nothing, so that Spark took their blocks through the driver."""
    vectors = [r[1] for r in rows(40, 0.2)]
    df = spark.createDataFrame([(i, vectors[i % 40]) for i in range(4000)], SCHEMA)
    found = build_index(df, "id", "e").search(asked(df), 20)
    assert found.count() == 1600
    got = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
    # 100 copies of each: the 20 smallest of a query's own.
    assert {(r["query"], r["id"]) for r in got} == {(q, q % 40 + 40 * k) for q in range(0, 4000, 50) for k in range(20)}
