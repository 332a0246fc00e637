import pytest
from pyspark.sql import functions as F

from graphloom.operators.pagerank import pagerank
from graphloom.operators.relations import co_user, rating_within_days, same_rating
from tests.conftest import frame, shared, visits


def iterated(nodes, weight, damping=0.85, rounds=200):
    """Power iteration over the written pairs."""
    out = {n: {} for n in nodes}
    for (a, b), w in weight.items():
        out[a][b] = out[b][a] = w
    rank = {n: 1 / len(nodes) for n in nodes}
    for _ in range(rounds):
        idle = sum(r for n, r in rank.items() if not out[n])
        new = {n: (1 - damping) / len(nodes) + damping * idle / len(nodes) for n in nodes}
        for n, r in rank.items():
            total = sum(out[n].values())
            for o, w in out[n].items():
                new[o] += damping * r * w / total
        rank = new
    return rank


@pytest.mark.parametrize("build", [co_user, same_rating])
def test_equals_iteration_over_pairs(spark, build):
    rows = [*visits(7, 25, 12), (500, 900, 1, None), (501, 901, 2, None)]
    relation = build(frame(spark, rows))
    keyed = [(tuple(r)[1:-1], r.u) for r in relation.members.collect()]
    want = iterated({n for _, n in keyed}, shared(keyed))
    got = {r.node: r["rank"] for r in pagerank(relation, tolerance=1e-13).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[n] - want[n]) < 1e-9 for n in want)
    assert abs(sum(got.values()) - 1) < 1e-9


def test_datasets_have_ranks_of_their_own(spark):
    rows = visits(8, 10, 5)
    x = frame(spark, rows).withColumn("dataset", F.lit("x"))
    y = frame(spark, [*rows, (77, 88, 1, None)]).withColumn("dataset", F.lit("y"))
    both = {(r.dataset, r.node): r["rank"] for r in pagerank(co_user(x.unionByName(y)), rounds=30).collect()}
    for name, one in (("x", x), ("y", y)):
        alone = {(name, r.node): r["rank"] for r in pagerank(co_user(one), rounds=30).collect()}
        assert all(abs(both[n] - v) < 1e-9 for n, v in alone.items())
        assert abs(sum(alone.values()) - 1) < 1e-9


def test_little(spark):
    assert pagerank(co_user(frame(spark, []))).collect() == []
    assert [r["rank"] for r in pagerank(co_user(frame(spark, [(1, 1, 1, None)]))).collect()] == [1.0]
    with pytest.raises(ValueError):
        pagerank(rating_within_days(frame(spark, visits(8, 3, 3))))
