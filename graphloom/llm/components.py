"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize


def _with_smallest(links: DataFrame) -> DataFrame:
    """Both directions (u, v) with m, the smallest of u and its neighbours."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(low, "u").select("u", "v", F.least("m", "u").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(id, label) for the ids in links (a, b): the smallest id that can be reached.

    The smallest ids themselves are left out, as is any id that only links to itself.

    Large and small stars in turn: each node hangs its larger neighbours, then its smaller ones, on
    the smallest. Links only shrink towards stars, and after a number of rounds that grows with the
    logarithm of the longest path nothing changes. Each round is a written table. Repeated links
    and self links do not matter.
    """
    pair = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    now = materialize(pair.distinct(), "links")
    before = None
    while True:
        state = now.agg(
            F.count("*"), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
        )
        now = materialize(small.distinct(), "links")
    return now.select(F.col("u").alias("id"), F.col("v").alias("label"))
