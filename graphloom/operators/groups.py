"""Pairs within groups, complete at any size of a group.

A key shared by d nodes stands for d(d-1)/2 pairs. How many members a key has decides how its pairs
are dealt to tasks, and never which pairs there are.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.hot import join_spread
from graphloom.scratch import materialize

TILE = 512  # members of a key that a task meets at once, on each side


def group_sizes(rows: DataFrame, keys: list[str], above: int = 1) -> DataFrame:
    """Rows per key, of keys with more than ``above``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("size")).where(F.col("size") > above)


def pairs_in_groups(
    rows: DataFrame, keys: list[str], member: str, keep: Column, tile: int = TILE
) -> DataFrame:
    """Rows ``a`` and ``b`` (structs of what is not a key) of each two rows with equal keys.

    ``rows`` must be distinct, and is read several times, so a written table is best; each ordered
    pair is met once, and ``keep``, over ``a`` and ``b``, says which are wanted. The keys with more than
    ``tile`` members are counted first. Without any, rows meet on their keys alone. Else the members of a
    key are parted into tiles by a hash of ``member``, as many as its exact count asks for, and each pair
    of tiles is a join key of its own: most keys are one tile, and a hot one is many tasks of the
    same bounded size.
    """
    rest = [c for c in rows.columns if c not in keys]
    large = materialize(group_sizes(rows, keys, tile), "large-keys")
    if large.isEmpty():
        a, b = (rows.select(*keys, F.struct(*rest).alias(name)) for name in ("a", "b"))
        return a.join(b, keys).where(keep)
    sized = join_spread(rows, large, keys, [member], "left")
    tiled = sized.withColumn("_tiles", F.ceil(F.coalesce("size", F.lit(1)) / tile).cast("int"))
    tiled = tiled.select(
        *keys,
        F.struct(*rest).alias("_row"),
        F.pmod(F.xxhash64(member), F.col("_tiles")).cast("int").alias("_own"),
        F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_other"),
    )

    def side(name: str, first: str, second: str) -> DataFrame:
        return tiled.select(*keys, F.col(first).alias("_i"), F.col(second).alias("_j"), F.col("_row").alias(name))

    met = side("a", "_own", "_other").join(side("b", "_other", "_own"), [*keys, "_i", "_j"])
    return met.where(keep).drop("_i", "_j")


def lists_in_groups(
    rows: DataFrame, keys: list[str], member: str, keep: Callable[[Column, Column], Column] | None = None, tile: int = TILE
) -> DataFrame:
    """The pairs of ``pairs_in_groups`` as lists: ``keys, src, to``, with the larger members that ``src`` meets.

    A key's rows are one sorted list, and each of them meets what comes after it, so what is written is one
    row per member and no row per pair. A key with more than ``tile`` members is parted by a hash into
    lists of about that size, and each two of its lists are a join key. ``keep`` says of two rows
    (structs of what is not a key, the smaller member first) whether they are wanted.
    """
    rest = [c for c in rows.columns if c not in keys and c != member]
    row = F.struct(member, *rest) if rest else F.col(member)
    listed = F.sort_array(F.collect_list(row)).alias("_all")

    def of(x: Column) -> Column:
        return x.getField(member) if rest else x

    def met(found: DataFrame, near: Column) -> DataFrame:
        if keep is not None or rest:
            wanted = keep or (lambda x, y: F.lit(True))
            near = F.filter(near, lambda y: (of(F.col("_x")) < of(y)) & wanted(F.col("_x"), y))
        found = found.select(*keys, of(F.col("_x")).alias("src"), near.alias("to")).where(F.size("to") > 0)
        return found.withColumn("to", F.col("to").getField(member)) if rest else found

    def within(lists: DataFrame) -> DataFrame:
        placed = lists.where(F.size("_all") > 1).select(*keys, "_all", F.posexplode("_all").alias("_at", "_x"))
        return met(placed, F.slice("_all", F.col("_at") + 2, F.size("_all")))

    large = materialize(group_sizes(rows, keys, tile), "large-keys")
    if large.isEmpty():
        return within(rows.groupBy(*keys).agg(listed))
    sized = join_spread(rows, large, keys, [member], "left")
    sized = sized.withColumn("_tiles", F.ceil(F.coalesce("size", F.lit(1)) / tile).cast("int"))
    own = F.pmod(F.xxhash64(member), F.col("_tiles")).cast("int").alias("_own")
    lists = materialize(sized.groupBy(*keys, "_tiles", own).agg(listed), "lists")
    each = lists.where(F.col("_tiles") > 1).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))

    def side(name: str, first: str, second: str) -> DataFrame:
        return each.select(*keys, F.col(first).alias("_i"), F.col(second).alias("_j"), F.col("_all").alias(name))

    tiles = side("_a", "_own", "_other").join(side("_b", "_other", "_own"), [*keys, "_i", "_j"])
    tiles = tiles.select(*keys, F.explode("_a").alias("_x"), "_b")
    after = F.filter("_b", lambda y: of(F.col("_x")) < of(y))
    return within(lists.where(F.col("_tiles") == 1)).unionByName(met(tiles, F.col("_b") if rest or keep else after))


def complete(rows: DataFrame) -> DataFrame:
    """Rows without a null; one plain filter per column, which reaches the scan."""
    return reduce(lambda df, c: df.where(F.col(c).isNotNull()), rows.columns, rows)
