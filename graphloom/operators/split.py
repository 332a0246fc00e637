"""Interactions parted by time into what a model may learn from and what it is tested on."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.hot import join_spread

BUCKETS = 4096  # of time that are counted in a round, and so rows that come to the driver


def time_at(rows: DataFrame, percent: int, ts: str = "ts") -> datetime | None:
    """The first time by which ``percent`` of the rows with a time have happened; None without any. Exact.

    Rows are counted per bucket of time, and the bucket in which the share is reached is parted
    again until it is one microsecond. So nothing is sorted, a round shuffles bucket counts only, and
    there are as many rounds as the length of the calendar has digits to the base ``BUCKETS``.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    micros = F.unix_micros(F.col(ts).cast("timestamp_ntz").cast("timestamp"))
    x = rows.where(F.col(ts).isNotNull()).select(micros.alias("x"))
    low, high, n = x.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if not n:
        return None
    want = -(-n * percent // 100)  # rows that must have happened
    while low < high:
        width = -(-(high - low + 1) // BUCKETS)
        bucket = F.expr(f"(x - {low}) div {width}").alias("bucket")
        counts = x.where(F.col("x").between(low, high)).groupBy(bucket).agg(F.count("*").alias("n"))
        for number, here in sorted(tuple(r) for r in counts.collect()):
            if want <= here:
                low, high = low + number * width, min(high, low + (number + 1) * width - 1)
                break
            want -= here
    return datetime(1970, 1, 1) + timedelta(microseconds=low)


def time_split(interactions: DataFrame, percent: int = 80) -> DataFrame:
    """``interactions`` with ``part``: ``train`` up to the time by which ``percent`` of them had happened, and
    after it ``test``, or ``known`` where the user and item had met by then.

    Rows of one time are never parted, and no pair of the test rows is among the others, so what is
    to be foretold has not been seen. A row without a time has no part. Pairs that train and later
    rows share are joined on both, which parts hot users and items.
    """
    cut = time_at(interactions, percent)
    if cut is None:
        return interactions.withColumn("part", F.lit(None).cast("string"))
    early = F.col("ts") <= F.lit(cut).cast("timestamp_ntz")
    pair = ["dataset", "u", "i"]
    seen = interactions.where(early).select(*pair).where("u IS NOT NULL AND i IS NOT NULL").distinct()
    seen = seen.withColumn("seen", F.lit(True))
    joined = join_spread(interactions, seen, pair, ["ts"], "left")
    later = F.when(F.col("seen"), "known").otherwise("test")
    part = F.when(early, "train").when(F.col("ts").isNotNull(), later)
    return joined.withColumn("part", part).select(*interactions.columns, "part")
