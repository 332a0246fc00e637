"""PageRank over a relation, from its members: no pair is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.counts import partners
from graphloom.operators.hot import join_spread
from graphloom.operators.relations import Relation, with_members
from graphloom.scratch import materialize


def pagerank(relation: Relation, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """``dataset, node, rank``: ranks of the nodes of each dataset, which add up to 1.

    A step goes from a node to another one with a chance in proportion to the keys that both have, as
    along the pairs and their weights. A key passes on the sum of what its members give, and a
    member takes all of it but its own part, so a round is linear in the members. A node that
    shares no key gives its rank to all nodes alike. Rounds end when no dataset's ranks change by
    more than ``tolerance`` in all, or after ``rounds``. Relations within days have no weights.
    """
    if relation.days is not None:
        raise ValueError("a relation within days has no weight to go by")
    relation = with_members(relation)
    keys, node = relation.keys, relation.node
    members = relation.members
    weights = partners(relation).groupBy("dataset", F.col(node).alias("node")).agg(F.sum("partners").alias("weight"))
    weights = materialize(weights, "weights")
    sizes = weights.groupBy("dataset").agg(F.count("*").alias("nodes"))
    fixed = materialize(join_spread(weights, sizes, ["dataset"], ["node"]), "nodes")
    now = materialize(fixed.withColumn("rank", 1 / F.col("nodes")), "ranks")
    for _ in range(rounds):
        given = now.where("weight > 0").select("dataset", F.col("node").alias(node), (F.col("rank") / F.col("weight")).alias("x"))
        # a node with a hot number of keys is spread, and so are the members of a hot key
        at_keys = materialize(join_spread(members, given, ["dataset", node], keys[1:]), "given")
        sums = at_keys.groupBy(*keys).agg(F.sum("x").alias("total"))
        taken = join_spread(at_keys, sums, keys, [node]).groupBy("dataset", F.col(node).alias("node"))
        taken = taken.agg(F.sum(F.col("total") - F.col("x")).alias("taken"))
        idle = F.coalesce(F.sum(F.when(F.col("weight") == 0, F.col("rank"))), F.lit(0.0))
        dangling = now.groupBy("dataset").agg(idle.alias("idle"))
        both = now.join(taken, ["dataset", "node"], "left")
        both = join_spread(both, dangling, ["dataset"], ["node"])
        got = F.coalesce("taken", F.lit(0.0)) + F.col("idle") / F.col("nodes")
        rank = (1 - damping) / F.col("nodes") + damping * got
        after = both.select("dataset", "node", "weight", "nodes", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("moved"))
        after = materialize(after, "ranks")
        moved = after.groupBy("dataset").agg(F.sum("moved").alias("moved")).agg(F.max("moved")).first()[0]
        now = after.drop("moved")
        if moved is None or moved <= tolerance:
            break
    return now.select("dataset", "node", "rank")
