from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.operators.bipartite import bipartite_edges, k_core, min_degree
from graphloom.operators.clean import accepted, dedupe_latest, reject_report
from graphloom.operators.nodes import node_features, node_index, number_keys
from graphloom.sources.interactions import interactions_a
from tests.conftest import SMALL, TINY, frame, visits

BAD = [(None, 1, 3, None), (1, None, 9, None), (1, 1, 0, None), (1, 1, 6, None), (1, 1, None, None)]


@pytest.mark.parametrize(
    "sf_dir, k, sizes",
    [
        (TINY, 15, (5342, 146, 200)),
        (TINY, 20, (4790, 135, 180)),
        (TINY, 22, (0, 0, 0)),
        (SMALL, 20, (56786, 1396, 1943)),
    ],
)
def test_core_sizes(spark, sf_dir, k, sizes):
    core = k_core(bipartite_edges(interactions_a(spark, sf_dir)), k)
    assert (core.count(), core.select("u").distinct().count(), core.select("i").distinct().count()) == sizes


def test_core_is_stable(spark):
    core = k_core(bipartite_edges(frame(spark, visits(5))), 4)
    assert not core.isEmpty()
    for key in ("u", "i"):
        assert core.groupBy(key).count().where("count < 4").isEmpty()
    assert k_core(core, 4).count() == core.count()


def test_min_degree_is_one_pass(spark):
    edges = bipartite_edges(frame(spark, visits(5)))
    kept = min_degree(edges, 10)
    assert {r.i for r in kept.select("i").distinct().collect()} == {
        r.i for r in edges.groupBy("i").count().where("count >= 10").collect()
    }


def test_index_is_dense_and_ordered(spark):
    index = node_index(frame(spark, visits(6))).collect()
    for ntype in ("user", "item"):
        rows = sorted((r.key, r.nid) for r in index if r.ntype == ntype)
        assert [n for _, n in rows] == list(range(len(rows)))
        assert len({k for k, _ in rows}) == len(rows)


def test_text_keys_are_numbered(spark):
    df = frame(spark, visits(6)).withColumns({"u": F.concat(F.lit("U"), "u"), "i": F.concat(F.lit("I"), "i")})
    index = node_index(df)
    numbered = number_keys(df, index)
    assert numbered.count() == df.count()
    back = {(r.ntype, r.nid): r.key for r in index.collect()}
    want = sorted(map(str, df.select("u", "i", "r", "ts").collect()))
    rows = [(back["user", r.u], back["item", r.i], r.r, r.ts) for r in numbered.collect()]
    assert sorted(map(str, spark.createDataFrame(rows, df.drop("dataset").schema).collect())) == want


def test_each_row_has_one_reason(spark):
    df = frame(spark, visits(7) + visits(7)[:5] + BAD)
    report = {r.reason: r.n for r in reject_report(df, "t").collect()}
    kept = dedupe_latest(accepted(df)).count()
    assert report["null_key"] == 2 and report["bad_rating"] == 2
    assert sum(report.values()) + kept == df.count()


def test_report_of_nothing(spark):
    report = {r.reason: r.n for r in reject_report(frame(spark, []), "t").collect()}
    assert report == {"null_key": 0, "bad_rating": 0, "superseded": 0}


def test_features_without_grades(spark):
    (row,) = node_features(frame(spark, [(1, 1, None, None)])).collect()
    assert (row.events, row["items"], row.r_mean, row.r_stddev, row.active_days) == (1, 1, None, None, 0)


def test_equal_grades_have_no_deviation(spark):
    rows = spark.range(200_001).selectExpr("'t' AS dataset", "1L AS u", "id % 3 AS i", "3 AS r", "timestamp_ntz'2024-01-01' AS ts")
    (row,) = node_features(rows).collect()
    assert (row.events, row.r_mean, row.r_stddev) == (200_001, 3.0, 0.0)


def test_the_last_row_is_found_without_a_sort(spark):
    rows = [
        (1, 1, 2, datetime(1969, 12, 31, 23, 59, 59, 999999)),
        (1, 1, None, datetime(1969, 12, 31, 23, 59, 59, 999999)),
        (1, 1, 5, None),
        (1, 2, None, None),
        (1, 3, None, datetime(2024, 2, 29, 12, 30, 1, 5)),
        (1, 4, -7, None),
        (1, 4, None, None),
    ]
    last = dedupe_latest(frame(spark, rows))
    assert {(r.i, r.r, r.ts) for r in last.collect()} == {(1, *rows[0][2:]), (2, None, None), (3, *rows[4][2:]), (4, -7, None)}
    assert "SortAggregate" not in last._jdf.queryExecution().executedPlan().toString()


def test_core_of_a_long_chain(spark):
    """Every round takes two nodes off the ends of a path; a ladder beside it stays."""
    path = [(n // 2, (n + 1) // 2, 1, None) for n in range(24)]
    square = [(100 + a, 100 + b, 1, None) for a in range(3) for b in range(3)]
    core = k_core(bipartite_edges(frame(spark, path + square)), 2)
    assert {(r.u, r.i) for r in core.collect()} == {(u, i) for u, i, *_ in square}


def test_rows_without_a_number_stay(spark):
    df = frame(spark, [(None, 1, 3, None), (1, 2, 3, None)])
    assert sorted(map(str, number_keys(df, node_index(df)).select("u", "i").collect())) == ["Row(u=0, i=1)", "Row(u=None, i=0)"]
