"""Joins with hot keys: the rows are those of a plain join, and only hot keys are repeated."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators.hot import fresh, hot_keys, join_spread


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "8")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def skewed(spark, n=6000, seed=1):
    """A third of the rows on one key, some on a null, the rest on many."""
    rng = random.Random(seed)
    keys = [0 if rng.random() < 1 / 3 else None if rng.random() < 0.1 else rng.randrange(1, 900) for _ in range(n)]
    return spark.createDataFrame([("d", k, v) for v, k in enumerate(keys)], "dataset string, k bigint, v bigint")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_rows_are_those_of_a_plain_join(spark, how):
    rows = skewed(spark)
    side = spark.createDataFrame([("d", k, f"s{k}", True) for k in [None, *range(0, 600)]], "dataset string, k bigint, salt string, key_hash boolean")
    got = join_spread(rows, side, ["dataset", "k"], ["v"], how)
    want = rows.join(side, ["dataset", "k"], how)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not want.isEmpty()


def test_hot_keys_are_found_with_their_share(spark):
    rows = skewed(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = {r.h: r.n for r in rows.groupBy(F.xxhash64("k").alias("h")).agg(F.count("*").alias("n")).collect()}
    found = {r.key_hash: r.salts for r in hot_keys(rows, ["k"]).collect()}
    want = {h: -(-n * parts // 6000) for h, n in hashed.items() if n * parts > 6000}
    assert found == want and len(found) == 1


def test_only_hot_keys_are_repeated(many_partitions):
    """With 1,000 partitions a side of 900 rows grows by the salts of hot keys, not a thousand times."""
    spark = many_partitions
    rows = skewed(spark)
    side = spark.range(900).selectExpr("'d' AS dataset", "id AS k")
    hot = {r.key_hash: r.salts for r in hot_keys(rows, ["dataset", "k"]).collect()}
    assert 2 <= len(hot) <= 1000 and sum(hot.values()) <= 2000
    plan = join_spread(rows, side, ["dataset", "k"], ["v"])
    hashes = [r.h for r in side.select(F.xxhash64("dataset", "k").alias("h")).collect()]
    repeated = sum(hot.get(h, 1) for h in hashes)
    assert repeated <= 900 + 2000
    assert plan.count() == rows.where("k IS NOT NULL").count()


def test_uneven_types_are_refused(spark):
    rows = spark.createDataFrame([(1, 2.0)], "k int, f double")
    with pytest.raises(TypeError):
        join_spread(rows, spark.createDataFrame([(1,)], "k bigint"), ["k"], ["f"])
    with pytest.raises(TypeError):
        join_spread(rows, rows.select("f"), ["f"], ["k"])


def test_names_are_new(spark):
    df = spark.createDataFrame([(1, 2)], "salt int, SALT1 int")
    assert fresh("salt", df) == "salt2" and fresh("other", df) == "other"


def test_empty_tables(spark):
    rows = skewed(spark).limit(0)
    assert join_spread(rows, skewed(spark).select("dataset", "k"), ["dataset", "k"], ["v"]).isEmpty()
    assert hot_keys(rows, ["k"]).isEmpty()
