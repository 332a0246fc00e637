import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators.components import components, labelled, stars
from graphloom.operators.counts import member_pairs, neighbours, partners
from graphloom.operators.relations import co_user, pairs, rating_within_days, runs, same_rating
from tests.conftest import frame, visits


def smallest(nodes, edges):
    """Union-find: each node with the smallest one it reaches."""
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in edges:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def named(df):
    rows = df.collect()
    got = {r.node: r.component for r in rows}
    assert len(got) == len(rows)
    return got


def sparse(seed, users=80, items=150):
    rng = random.Random(seed)
    rows = visits(seed, 10, 6)
    moved = [(u, i + 1000, r, ts) for u, i, r, ts in rows]
    return moved + [(rng.randrange(users), rng.randrange(items), rng.choice([1, 2, None]), ts) for *_, ts in rows for _ in range(2)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("build", [co_user, same_rating, rating_within_days])
def test_relations(spark, seed, build):
    relation = build(frame(spark, sparse(seed)))
    edges = [(r.src, r.dst) for r in pairs(relation).collect()]
    nodes = {r.u for r in relation.members.select("u").collect()}
    want = smallest(nodes, edges)
    assert named(components(relation)) == want
    assert len(set(want.values())) > 1


@pytest.mark.parametrize("shape", ["path", "backward", "star", "cycle", "random", "tree", "shuffled"])
def test_shapes(spark, shape):
    n, rng = 300, random.Random(9)
    order = list(range(n))
    if shape == "shuffled":
        rng.shuffle(order)
    edges = {
        "path": [(k, k + 1) for k in range(n - 1)],
        "backward": [(n - k, n - k - 1) for k in range(n - 1)],
        "star": [(n - 1, k) for k in range(n - 1)],
        "cycle": [(k, (k + 1) % n) for k in range(n)],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)],
        "tree": [(k, k // 2) for k in range(1, n)],
        "shuffled": list(zip(order, order[1:])),
    }[shape]
    rows = [("t", max(e), min(e)) for e in edges if e[0] != e[1]]
    found = stars(spark.createDataFrame(rows, "dataset string, a bigint, b bigint"))
    nodes = spark.range(n + 5).selectExpr("'t' AS dataset", "id AS node")
    assert named(labelled(nodes, found)) == smallest(range(n + 5), edges)


def test_text_nodes_and_two_datasets(spark):
    rows = [("x", 1, "a"), ("x", 1, "c"), ("x", 2, "c"), ("x", 2, "é"), ("y", 1, "a"), ("y", 3, "c"), ("x", 9, "z")]
    df = spark.createDataFrame(rows, "dataset string, i bigint, u string")
    got = {(r.dataset, r.node): r.component for r in components(co_user(df)).collect()}
    assert got == {("x", "a"): "a", ("x", "c"): "a", ("x", "é"): "a", ("x", "z"): "z", ("y", "a"): "a", ("y", "c"): "c"}


def test_components_of_nothing(spark):
    assert components(co_user(frame(spark, []))).collect() == []
    assert components(rating_within_days(frame(spark, [(1, 1, None, None)]))).collect() == []


def test_runs_of_days(spark):
    df = spark.createDataFrame([(u, d) for u, d in [(1, 0), (2, 7), (3, 14), (4, 22), (1, 29), (5, 60)]], "u bigint, d int")
    df = df.selectExpr("'t' AS dataset", "u", "1L AS i", "5 AS r", "timestamp_ntz '2024-01-01 23:00:00' + make_dt_interval(d) AS ts")
    relation = rating_within_days(df)
    run = {(r.u, r.run) for r in runs(relation).members.collect()}
    assert run == {(1, 0), (2, 0), (3, 0), (4, 1), (1, 1), (5, 2)}
    assert named(components(relation)) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


@pytest.mark.parametrize("same_item", [True, False])
def test_counts_within_days(spark, same_item):
    rows = visits(4)
    relation = rating_within_days(frame(spark, rows), 7, same_item)
    members = [tuple(r) for r in relation.members.collect()]
    near = {
        m: sum(m[:-2] == o[:-2] and m[-2] != o[-2] and abs(m[-1] - o[-1]) <= 7 for o in members) for m in members
    }
    got = {tuple(r)[:-1]: r.partners for r in partners(relation).select(*relation.members.columns, "partners").collect()}
    assert got == near
    keys = {}
    for m, n in near.items():
        have, half = keys.get(m[:-2], (0, 0))
        keys[m[:-2]] = (have + 1, half + n / 2)
    assert {tuple(r)[:-2]: (r.members, r.pairs) for r in member_pairs(relation).collect()} == keys


def test_counts_without_days(spark):
    rows = visits(5)
    relation = co_user(frame(spark, rows))
    total = pairs(relation).agg(F.sum("w")).first()[0]
    assert member_pairs(relation).agg(F.sum("pairs")).first()[0] == total


@pytest.mark.parametrize("precision", [6, 11])
def test_estimated_neighbours_stay_within_their_error(spark, precision):
    rows = [(u, (u * 7 + k * k) % 97, 1 + u % 2, ts) for k, (*_, ts) in enumerate(visits(6)[:8]) for u in range(400)]
    df = frame(spark, rows)
    for relation in (co_user(df), rating_within_days(df, 7, False)):
        counted = {}
        for r in pairs(relation).collect():
            for n in (r.src, r.dst):
                counted[n] = counted.get(n, 0) + 1
        got = {r.node: r.neighbours for r in neighbours(relation, precision).collect()}
        error = 1.04 / 2 ** (precision / 2)
        assert set(counted) <= set(got)
        assert all(abs(got[n] - counted.get(n, 0)) <= max(1, 5 * error * counted.get(n, 0)) for n in got)
        assert abs(sum(got.values()) - sum(counted.values())) <= 4 * error * sum(counted.values())
