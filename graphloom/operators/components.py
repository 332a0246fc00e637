"""Connected components, of a relation from its members and of any edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.hot import join_spread
from graphloom.operators.relations import Relation, runs, with_members
from graphloom.scratch import materialize


def components(relation: Relation) -> DataFrame:
    """``dataset, node, component`` of every node of the relation; the smallest node reachable names it.

    No pair is written. The members of a key hang together, so each gets one edge, to the smallest of
    its key: as many edges as members, at any size of a key. A node alone in its keys is its own
    component. A relation within days is turned into one by runs of days first.
    """
    relation = with_members(runs(relation))
    members, keys, node = relation.members, relation.keys, relation.node
    centres = members.groupBy(*keys).agg(F.min(node).alias("b"))
    edges = join_spread(members, centres, keys, [node]).where(F.col(node) > F.col("b"))
    edges = edges.select("dataset", F.col(node).alias("a"), "b")
    nodes = members.select("dataset", F.col(node).alias("node")).distinct()
    return labelled(nodes, stars(edges))


def labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes with their component; one that has no star is alone."""
    names = found.select("dataset", F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(names, ["dataset", "node"], "left").select(
        "dataset", "node", F.coalesce("component", "node").alias("component")
    )


def stars(edges: DataFrame) -> DataFrame:
    """Edges ``dataset, a, b`` with a > b, contracted until each a has one b, the smallest of its component.

    A round takes two steps, both of which keep what is connected. First each edge (a, b) goes
    from a to the smallest neighbour of b, if that is below b. Then all smaller neighbours of a node
    are tied to the smallest of them. Rounds grow with the logarithm of the longest path, about.
    Nothing holds the neighbours of a node: the smallest is an aggregate, and the edges of a
    hot centre are spread over tasks. Each step is written, so a lost executor costs one step.
    """
    now = materialize(edges.distinct(), "edges")
    state = _fingerprint(now)
    while True:
        lowest = now.groupBy("dataset", "a").agg(F.min("b").alias("low"))
        below = lowest.select("dataset", F.col("a").alias("b"), "low")
        moved = join_spread(now, below, ["dataset", "b"], ["a"], "left")
        now = materialize(moved.select("dataset", "a", F.coalesce("low", "b").alias("b")).distinct(), "edges")
        lowest = materialize(now.groupBy("dataset", "a").agg(F.min("b").alias("low")), "lowest")
        tied = join_spread(now, lowest, ["dataset", "a"], ["b"]).where(F.col("b") > F.col("low"))
        tied = tied.select("dataset", F.col("b").alias("a"), F.col("low").alias("b"))
        now = materialize(tied.unionByName(lowest.withColumnRenamed("low", "b")).distinct(), "edges")
        before, state = state, _fingerprint(now)
        if state == before:
            return now


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of edges and two hashes over all of them, in whatever order."""
    one, two = F.xxhash64("dataset", "a", "b"), F.xxhash64(F.lit("y"), "dataset", "a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(one), F.bit_xor(two)).first())
