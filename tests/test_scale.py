"""How the work is laid out: what is written, shuffled and read once."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import __spark_entry__ as registry
from graphloom.operators import counts, nodes, relations, summary, topk
from graphloom.operators.clean import dedupe_latest
from graphloom.operators.relations import text_overlap
from graphloom.scratch import materialize, scratch_path, setting, step
from graphloom.sources.store import Run
from tests.conftest import TINY, frame, shared, visits
from tests.test_relations import overlap
from tests.test_topk import brute_force, ranking


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Labels of the tables that the relations write."""
    labels = []

    def noted(df, label):
        labels.append(label)
        return materialize(df, label)

    monkeypatch.setattr(relations, "materialize", noted)
    return labels


def test_pairs_are_counted_without_a_row_per_pair_in_a_shuffle(spark):
    made = plan(relations.pairs(relations.with_members(relations.co_user(frame(spark, visits(1))))))
    assert "functions=[count(1)]" not in made and "collect_list" in made


def test_a_node_in_most_keys_is_dealt_to_several_tasks(spark):
    rows = [(0, i, 1, None) for i in range(200)] + [(1 + i % 30, i, 1, None) for i in range(200)]
    rows += [(1 + (i * 7) % 30, i, 1, None) for i in range(0, 200, 3)]
    relation = relations.co_user(frame(spark, rows))
    parts = relations._gathered(
        relations.lists_in_groups(relation.members, relation.keys, "u"), relations.with_members(relation)
    )
    assert parts.where("src = 0").count() > 1
    got = {(r.src, r.dst): r.w for r in relations.pairs(relation).collect()}
    assert got == shared([(i, u) for u, i, r, ts in set(rows)])


def test_members_of_last_rows_are_distinct_without_a_shuffle(spark):
    graded = materialize(dedupe_latest(frame(spark, visits(5) * 2)), "graded")
    for build in (relations.co_user, relations.co_item, relations.same_rating, relations.rating_within_days):
        members = build(graded, once=True).members
        assert "Exchange" not in plan(members)
        assert sorted(map(tuple, members.collect())) == sorted(map(tuple, build(graded).members.collect()))


def test_the_last_row_is_found_without_taking_its_time_apart_again(spark):
    assert "make_dt_interval" not in plan(dedupe_latest(frame(spark, visits(5))))


def test_classes_of_texts_look_for_no_pairs(spark, written):
    texts = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, "c")], "doc_id bigint, text string")
    found = relations.text_overlap(texts)
    assert {(r.doc_id, r.class_id) for r in found.classes.collect()} == {(1, 1), (2, 1), (3, 3)}
    assert written == ["token-sets", "text-classes"]


def test_members_are_written_before_runs_of_days_are_looked_for(spark, written):
    relations.runs(relations.rating_within_days(frame(spark, visits(2))))
    assert written == ["members"]


@pytest.mark.parametrize("block, strip", [(3, 2), (8192, 512)])
def test_many_sets_of_hubs_are_compared_in_blocks(spark, monkeypatch, block, strip):
    used = []
    in_blocks = topk._in_blocks
    monkeypatch.setattr(topk, "_in_blocks", lambda *a: used.append(1) or in_blocks(*a))
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "STRIP", strip)
    rows = [(u, i, 1, None) for u in range(30) for i in range(8) if (u * 7 + i * i + u // 3) % 5 > 1]
    got = ranking(topk.topk_neighbours(relations.co_user(frame(spark, rows)), 3, 4))
    assert used and got == brute_force(shared([(i, u) for u, i, r, ts in rows]), 3)


def test_names_are_joined_once_and_then_numbered(spark):
    assert "lineitem" not in "".join(registry._number_keys(spark, TINY).inputFiles())


def test_a_numbered_side_goes_on_without_its_text(spark):
    rows = frame(spark, visits(6)).withColumns({c: F.col(c).cast("string") for c in "ui"})
    rows = materialize(rows, "rows")
    numbered = nodes.number_keys(rows, nodes.node_index(rows))
    last = numbered._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1]
    assert "u#" not in last.split("Project [", 1)[1].split("]", 1)[0]
    assert numbered.count() == rows.count() and numbered.where("u IS NULL OR i IS NULL").isEmpty()


def long_texts(seed: int) -> list[tuple]:
    """Texts of 33 to 300 tokens in families that share half of their tokens, more or less."""
    rng = random.Random(seed)
    texts = []
    for family in range(6):
        own = [f"f{family}x{k}" for k in range(rng.choice([40, 150, 300]))]
        for n in range(7):
            kept = [t for t in own if rng.random() < rng.choice([0.6, 0.7, 0.8])]
            texts.append((family * 10 + n, " ".join(kept + [f"y{rng.randrange(60)}" for _ in range(rng.randrange(20))])))
    return texts


@pytest.mark.parametrize("percent", [20, 40, 50])
def test_long_texts_by_brute_force(spark, percent):
    texts = long_texts(percent)
    _, want = overlap(texts, percent)
    got = relations.text_overlap(spark.createDataFrame(texts, "doc_id bigint, text string"), percent, 8)
    assert want and {(r.src, r.dst): r.w for r in got.pairs.collect()} == want


def test_one_rare_token_makes_no_candidates_of_long_texts(spark, monkeypatch):
    tables = {}

    def noted(df, label):
        tables[label] = materialize(df, label)
        return tables[label]

    monkeypatch.setattr(relations, "materialize", noted)
    words = [" ".join(f"w{n}x{k}" for k in range(150)) for n in range(10)]
    texts = [(n, f"rare {text}") for n, text in enumerate(words)] + [(100, f"{words[0]} more")]
    found = relations.text_overlap(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert [tuple(r) for r in found.pairs.collect()] == [(0, 100, 150)]
    assert tables["alike-candidates"].count() == 1


def test_keys_are_counted_without_joining_members_to_them(spark, monkeypatch):
    plans = []

    def noted(df, label):
        plans.append(plan(df))
        return materialize(df, label)

    monkeypatch.setattr(counts, "materialize", noted)
    rows = visits(8) + [(200, 0, 2, None), (201, 99, 3, None)]
    for build in (relations.co_user, relations.same_rating, relations.rating_within_days):
        relation = relations.with_members(build(frame(spark, rows)))
        counted = counts.key_counts(relation)
        got = counted.first()
        # one row per dataset is what is joined
        assert all("Join" not in p for p in plans) and "approx_top_k" not in plan(counted)
        per_node = counts.partners(relation).groupBy("u").agg(F.sum("partners").alias("n"))
        met = per_node.agg(F.count_if(F.col("n") > 0).alias("touched"), F.sum("n").alias("n")).first()
        sizes = [r.n for r in relation.members.groupBy(*relation.keys).agg(F.countDistinct("u").alias("n")).collect()]
        assert tuple(got) == ("t", met.touched, len(sizes), sum(sizes), max(sizes), met.n // 2)
        assert relations.count_pairs(relation, 7).first().pairs == relations.pairs(relation).count()


def scratch_tables(spark) -> set[str]:
    """Names of the tables now in the application's scratch folder."""
    root = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    return {p.name.rpartition("-")[0] for p in root.iterdir()} if root.exists() else set()


def test_a_step_leaves_its_result_only(spark):
    before = scratch_tables(spark)

    def two() -> DataFrame:
        inner = step(spark, lambda: materialize(spark.range(9), "step-inner").where("id > 2"), "step-middle")
        return inner.unionByName(materialize(spark.range(3), "step-other"))

    made = step(spark, two, "step-made")
    assert sorted(r.id for r in made.collect()) == [0, 1, 2, *range(3, 9)]
    assert scratch_tables(spark) - before == {"step-made"}


def test_writes_leave_no_shuffle_files(spark):
    """They went when the driver collected garbage, so those of a whole job lay on disk together."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*")}
    before = files()
    kept = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    one = materialize(kept, "counted")
    two = Run(spark, scratch_path(spark, "store"), "t").write(kept, "counted")
    assert not {f for f in files() - before if f.name.endswith(".data") and f.stat().st_size}
    assert one.count() == two.count() == 7


def test_settings_are_as_they_were(spark):
    name = "spark.sql.execution.useObjectHashAggregateExec"
    assert spark.conf.get(name) == "true"
    with setting(spark, name, "false"):
        assert spark.conf.get(name) == "false"
    assert spark.conf.get(name) == "true"
    spark.conf.set(name, "true")
    with pytest.raises(ZeroDivisionError), setting(spark, name, "false"):
        raise ZeroDivisionError
    assert spark.conf.get(name, None) == "true"
    spark.conf.unset(name)


def test_texts_leave_classes_and_pairs_only(spark):
    before = scratch_tables(spark)
    texts = [(k, f"red green blue w{k} v{k % 2}") for k in range(8)]
    found = text_overlap(spark.createDataFrame(texts, "doc_id bigint, text string"), 50)
    assert found.pairs.count() == 12
    assert found.classes.count() == 8
    assert scratch_tables(spark) - before <= {"text-classes", "alike-candidates", "alike", "large-keys"}


def dense(spark, days: bool):
    """600 users of whom each has several of four items, so keys are few and large."""
    rng = random.Random(5)
    first = datetime(2024, 1, 1)
    rows = [(u, i, 3, first + timedelta(days=rng.randrange(2))) for u in range(600) for i in range(4) if rng.random() < 0.7]
    build = relations.rating_within_days if days else relations.co_user
    return relations.with_members(build(frame(spark, rows)))


@pytest.mark.parametrize("days", [False, True])
def test_large_sketches_are_not_sent_with_each_member(spark, monkeypatch, days):
    plans = {}

    def noted(df, label):
        made = materialize(df, label)
        with setting(spark, "spark.sql.execution.useObjectHashAggregateExec", "false"):
            plans[label] = plan(df.select("*"))
        return made

    monkeypatch.setattr(counts, "materialize", noted)
    relation = dense(spark, days)
    estimates = {r.node: r.neighbours for r in counts.neighbours(relation, 7).collect()}
    # neither a sketch of each member is shuffled, nor rows with one sorted
    assert plans["neighbours"].count("Exchange hashpartitioning") == 1
    assert plans["neighbours"].index("BroadcastHashJoin") < plans["neighbours"].index("Sort [")
    monkeypatch.setattr(counts, "HELD", 0)
    as_before = {r.node: r.neighbours for r in counts.neighbours(relation, 7).collect()}
    assert estimates.keys() == as_before.keys()
    assert all(abs(estimates[n] - as_before[n]) <= 0.25 * as_before[n] for n in estimates)


def test_pairs_are_counted_in_rounds_and_leave_nothing(spark):
    for build in (relations.co_user, relations.rating_within_days):
        relation = relations.with_members(build(frame(spark, visits(11))))
        want = [(r.dataset, r.pairs) for r in relations.count_pairs(relation).collect()]
        assert want == [("t", relations.pairs(relation).count())]
        assert [tuple(r) for r in relations.count_pairs(relation, rounds=3).collect()] == want
        before = scratch_tables(spark)
        stats = summary.relation_stats(relation).collect()
        assert [r.pairs for r in stats] == [want[0][1]]
        assert scratch_tables(spark) - before <= {"relation-stats"}
        assert Path(relation.members.inputFiles()[0].removeprefix("file://")).exists()


def test_a_dense_relation_is_counted_in_several_rounds(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(summary, "count_pairs", lambda r, rounds: asked.append(rounds) or relations.count_pairs(r, rounds=rounds))
    [row] = summary.relation_stats(dense(spark, False), exact=10_000).collect()
    assert row.exact and row.pairs == relations.pairs(dense(spark, False)).count()
    assert asked == [-(-row.pair_key_count // (summary.AT_ONCE * row.members))] and asked[0] > 10
