"""Joins on keys of which a few may hold most of the rows.

Which keys are frequent is found by a summary with a counter for each of a bounded number of keys. Every
task makes one of its own rows and they are merged, so nothing is shuffled but summaries. A
key's rows are then spread over as many tasks as its share of all rows asks for, and only the rows
of such keys are repeated on the other side. The summary decides the layout and never the result.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = 16  # per shuffle partition: a key of one task's share of the rows is found for certain from 7 on
MOST = 1_000_000  # counters that Spark allows a summary


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, or with a number after it if a column of the frames, in any case, has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    return next(n for n in (f"{name}{k or ''}" for k in count()) if n.lower() not in taken)


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key_hash, salts) of keys with more rows than one task's share of all, ``salts`` such shares.

    At most as many keys as there are shuffle partitions, and twice as many salts in all. Keys are told
    apart by a 64-bit hash: two that share one are both spread, if one is hot.
    """
    parts = partitions(rows)
    counters = min(COUNTERS * parts, MOST)
    summary = rows.select(F.xxhash64(*keys).alias("key_hash")).agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(key_hash, {counters}, {counters})").alias("top")
    )
    salts = F.ceil(F.col("x.count") * parts / F.col("n")).cast("int")
    found = summary.select("n", F.explode("top").alias("x"))
    return found.select(F.col("x.item").alias("key_hash"), salts.alias("salts")).where(F.col("salts") > 1)


def join_spread(rows: DataFrame, side: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` on ``keys``, with the rows of hot keys dealt by a hash of ``by``.

    ``how`` is inner, left, left_semi or left_anti. A null key matches nothing, as in any join, and its rows are
    spread as well. The hot keys are two numbers each and at most one per shuffle partition, so
    they are broadcast, in both places from one exchange.
    """
    types = [{f.name: f.dataType.simpleString() for f in df.schema.fields} for df in (rows, side)]
    for key in keys:
        if types[0][key] != types[1][key] or any(t in types[0][key] for t in ("float", "double")):
            raise TypeError(f"{key} must be of one type on both sides, and none with several zeros")
    name, salts, salt = (fresh(n, rows, side) for n in ("key_hash", "salts", "salt"))
    hot = F.broadcast(hot_keys(rows, keys).toDF(name, salts))

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn(name, F.xxhash64(*keys)).join(hot, name, "left").drop(name)

    own = F.coalesce(F.pmod(F.xxhash64(*by), F.col(salts)), F.lit(0)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1))
    left = marked(rows).withColumn(salt, own).drop(salts)
    right = marked(side).withColumn(salt, each).drop(salts)
    return left.join(right, [*keys, salt], how).drop(salt)
