import random
from collections import defaultdict
from datetime import timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphloom.operators import relations
from graphloom.operators.relations import (
    co_item,
    co_user,
    pairs,
    rating_within_days,
    same_month,
    same_rating,
    text_overlap,
    union_members,
)
from graphloom.plans.build_graph import all_relations
from graphloom.sources.interactions import interactions_a
from tests.conftest import SMALL, frame, near, shared, visits

TILES = [1, 7, 512]


def found(df):
    rows = df.collect()
    assert all(r.src < r.dst for r in rows)
    got = {(r.src, r.dst): r.w for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("tile", TILES)
def test_pairs_are_complete_with_one_tile_and_many(spark, tile):
    rows = visits(1)
    df = frame(spark, rows)
    expected = {
        co_user: [(i, u) for u, i, r, ts in rows],
        co_item: [(u, i) for u, i, r, ts in rows],
        same_rating: [((i, r), u) for u, i, r, ts in rows if r is not None],
        same_month: [((i, ts.year, ts.month), u) for u, i, r, ts in rows],
    }
    for build, keyed in expected.items():
        relation = build(df)
        assert found(pairs(relation, tile)) == shared(keyed), build.__name__
        *_, node = relation.members.columns
        members = [(tuple(r)[:-1], r[node]) for r in relation.members.collect()]
        assert shared(members) == shared(keyed), build.__name__


@pytest.mark.parametrize("tile", TILES)
@pytest.mark.parametrize("same_item", [True, False])
def test_days(spark, tile, same_item):
    rows = visits(2)
    relation = rating_within_days(frame(spark, rows), 7, same_item)
    assert set(found(pairs(relation, tile))) == near(rows, 7, same_item)
    groups = defaultdict(list)
    for r in relation.members.collect():
        groups[tuple(r)[:-2]].append((r.u, r.day))
    by_members = {
        (u, u2)
        for members in groups.values()
        for (u, day), (u2, day2) in combinations(sorted(members), 2)
        if u != u2 and abs(day - day2) <= 7
    }
    assert by_members == near(rows, 7, same_item)


def test_months_are_told_apart(spark):
    rows = [(u, i, r, ts + timedelta(days=40 * (u % 3))) for u, i, r, ts in visits(3)]
    keyed = [((i, ts.year, ts.month), u) for u, i, r, ts in rows]
    assert len({k[1:] for k, _ in keyed}) > 3
    assert found(pairs(same_month(frame(spark, rows)))) == shared(keyed)


def test_two_datasets_are_the_union_of_both(spark):
    x = frame(spark, visits(1)).withColumn("dataset", F.lit("x"))
    y = frame(spark, visits(2)).withColumn("dataset", F.lit("y"))
    both = x.unionByName(y)
    for build in (co_user, co_item, same_rating, same_month, rating_within_days):
        together = pairs(build(both))
        apart = pairs(build(x)).unionByName(pairs(build(y)))
        assert together.exceptAll(apart).isEmpty() and apart.exceptAll(together).isEmpty()
    together = union_members(all_relations(both))
    apart = union_members(all_relations(x)).unionByName(union_members(all_relations(y)))
    assert together.exceptAll(apart).isEmpty() and apart.exceptAll(together).isEmpty()


def overlap(texts, percent):
    sets, first = {}, {}
    for d, text in sorted(texts):
        tokens = frozenset(t for t in (text or "").lower().split(" ") if t)
        if tokens:
            sets[d] = tokens
            first.setdefault(tokens, d)
    classes = {d: first[t] for d, t in sets.items()}
    want = {}
    for a, b in combinations(sorted(set(classes.values())), 2):
        w = len(sets[a] & sets[b])
        if 100 * w >= percent * len(sets[a] | sets[b]):
            want[a, b] = w
    return classes, want


TEXTS = [
    (0, "Red green  blue sun"),
    (1, "red GREEN blue moon"),
    (2, "red green moon star"),
    (3, "red red red"),
    (4, "sun moon star blue green"),
    (5, ""),
    (6, None),
    (7, "blue red green sun sun"),
    (8, "moon red blue green"),
]


@pytest.mark.parametrize("percent", [1, 40, 50, 60, 100])
def test_tokens_by_brute_force(spark, percent):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    got = text_overlap(df, percent, 2)
    classes, want = overlap(TEXTS, percent)
    assert {r.doc_id: r.class_id for r in got.classes.collect()} == classes
    assert found(got.pairs) == want


def test_shares_are_whole_numbers(spark):
    """55 of 100 tokens are 55 percent, which binary fractions miss by a little."""
    whole = [f"t{k}" for k in range(100)]
    texts = [(1, " ".join(whole)), (2, " ".join(whole[:55])), (3, " ".join(whole[:54]))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert found(text_overlap(df, 55).pairs) == {(1, 2): 55, (2, 3): 54}
    assert found(text_overlap(df, 54).pairs) == {(1, 2): 55, (1, 3): 54, (2, 3): 54}
    with pytest.raises(ValueError):
        text_overlap(df, 0)


@pytest.mark.parametrize("percent", [30, 50, 55, 75, 90])
def test_random_texts_by_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(relations, "RARE_BITS", 62)  # one bit of hash: nearly all tokens collide
    rng = random.Random(percent)
    words = [f"w{k}" for k in range(40)]
    texts = [(k, " ".join(rng.choice(words[: rng.choice([5, 40])]) for _ in range(rng.randrange(1, 30)))) for k in range(60)]
    texts += [(100 + k, "hot words of all " + texts[k][1]) for k in range(30)] + [(200, texts[3][1]), (200, texts[3][1])]
    classes, want = overlap(texts, percent)
    got = text_overlap(spark.createDataFrame(texts, "doc_id bigint, text string"), percent, 8)
    assert found(got.pairs) == want
    assert {r.doc_id: r.class_id for r in got.classes.collect()} == classes


def test_more_texts_never_take_an_edge_away(spark):
    more = TEXTS + [(100 + k, f"red green blue moon sun star w{k} v{k} x{k} y{k} z{k} q{k}") for k in range(60)]
    few, many = (
        found(text_overlap(spark.createDataFrame(t, "doc_id bigint, text string"), 50).pairs) for t in (TEXTS, more)
    )
    assert few and few.items() <= many.items()


def test_relations_nest(spark):
    a = interactions_a(spark, SMALL)
    users, rating, month, days = (
        pairs(build(a)).select("src", "dst") for build in (co_user, same_rating, same_month, rating_within_days)
    )
    assert rating.join(users, ["src", "dst"], "left_anti").isEmpty()
    assert month.join(users, ["src", "dst"], "left_anti").isEmpty()
    assert days.join(rating, ["src", "dst"], "left_anti").isEmpty()


def test_the_scan_is_pruned_and_nothing_is_crossed(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    relation = co_user(interactions_a(spark, SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan(relation.members)
    made = plan(pairs(relation))
    assert "Cartesian" not in made and "NestedLoop" not in made
    assert made.count("Exchange hashpartitioning") <= 4  # no key is large: members meet on their keys alone
