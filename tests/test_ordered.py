"""Successors and percentiles over range partitions, against sorting, with a group that fills most partitions."""

import random

import numpy as np
import pytest

from weftgraph.operators.ordered import following, percentiles

SCHEMA = "g string, t int, k long, x double"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    out = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice([None, *range(40)]), i, rnd.choice([None, rnd.gauss(0, 5), float(rnd.randint(0, 3))])) for i in range(900)]
    return [*out, ("one", 1, 5000, 2.5), ("none", 1, 5001, None)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def test_following(spark, df, rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want = set()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=order)
        want |= {(a[2], b[2]) for a, b in zip(own, own[1:])}
    assert {tuple(r) for r in following(df, "g", ["t"], "k").collect()} == want
    assert following(df.limit(0), "g", ["t"], "k").collect() == []


@pytest.mark.parametrize("groups", [["g"], []])
def test_percentiles(df, rows, groups):
    shares = {"least": 0.0, "low": 0.1, "mid": 0.5, "top": 1.0}
    own = {}
    for g, _, _, x in rows:
        if x is not None:
            own.setdefault((g,) if groups else (), []).append(x)
    got = {tuple(r)[: len(groups)]: r for r in percentiles(df, groups, "x", shares).collect()}
    assert got.keys() == own.keys()
    for g, xs in own.items():
        assert [got[g][n] for n in shares] == pytest.approx([float(np.quantile(xs, p)) for p in shares.values()])
    disc = {tuple(r)[: len(groups)]: r for r in percentiles(df, groups, "x", shares, discrete=True).collect()}
    assert {g: [disc[g][n] for n in shares] for g in own} == {g: [float(np.quantile(xs, p, method="inverted_cdf")) for p in shares.values()] for g, xs in own.items()}
    assert [tuple(r) for r in percentiles(df.limit(0), groups, "x", shares).collect()] == ([] if groups else [(None,) * 4])
    with pytest.raises(ValueError):
        percentiles(df, groups, "x", {"p": 1.5})
