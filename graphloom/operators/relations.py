"""Relations between users, or items, that share a key.

A relation has two forms. ``members`` holds each node of each key once, and is linear in the input;
it is what is stored, united and counted. ``pairs`` writes out ``src < dst`` with ``w``, the number of
keys that both have. Both are complete, whatever the size of a key; on dense data ``pairs`` is as
large as the relation is, so there the member form is the one to use.
"""

from collections.abc import Callable
from functools import cached_property, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import day_number, month_number, tokens
from graphloom.operators.groups import TILE, complete, group_sizes, lists_in_groups, pairs_in_groups
from graphloom.operators.hot import hot_keys, join_spread, partitions
from graphloom.scratch import ROW_BITS, discard, materialize, step

FEW = 64  # members of a key in time up to which all of them are compared
LONG, MET = 32, 8  # texts must meet on one rare token more for each so many tokens, and on so many at most
RARE_BITS = 22  # of a token's place in the order by rarity; more texts than that count alike


class Relation(NamedTuple):
    """Distinct rows of ``dataset``, the keys, the node and, for relations in time, ``day``.

    ``written`` says that ``members`` is a scan of a written table, so reading it again costs little.
    """

    members: DataFrame
    keys: list[str]
    node: str
    days: int | None = None
    written: bool = False


def with_members(relation: Relation) -> Relation:
    """The relation with its members written, once, for what reads them more than once."""
    if relation.written:
        return relation
    return relation._replace(members=materialize(relation.members, "members"), written=True)


def _members(rows: DataFrame, keys: list[str], node: str, days: int | None = None, once: bool = False) -> Relation:
    known = complete(rows)
    return Relation(known if once else known.distinct(), ["dataset", *keys], node, days)


def co_user(interactions: DataFrame, once: bool = False) -> Relation:
    """Users sharing an item. ``once``, here and below: each user has an item in one row only, as after
    ``dedupe_latest``, so the members are distinct as they stand."""
    return _members(interactions.select("dataset", "i", "u"), ["i"], "u", once=once)


def co_item(interactions: DataFrame, once: bool = False) -> Relation:
    """Items sharing a user."""
    return _members(interactions.select("dataset", "u", "i"), ["u"], "i", once=once)


def same_rating(interactions: DataFrame, once: bool = False) -> Relation:
    """Users who gave an item the same grade."""
    return _members(interactions.select("dataset", "i", "r", "u"), ["i", "r"], "u", once=once)


def same_month(interactions: DataFrame) -> Relation:
    """Users of an item in the same calendar month."""
    month = month_number(F.col("ts")).alias("month")
    return _members(interactions.select("dataset", "i", month, "u"), ["i", "month"], "u")


def rating_within_days(
    interactions: DataFrame, days: int = 7, same_item: bool = True, once: bool = False
) -> Relation:
    """Users with an equal grade (of the same item) at most ``days`` calendar days apart."""
    match = ["i", "r"] if same_item else ["r"]
    day = day_number(F.col("ts")).alias("day")
    return _members(interactions.select("dataset", *match, "u", day), match, "u", days, once and same_item)


def pairs(relation: Relation, tile: int = TILE) -> DataFrame:
    """All pairs, as ``dataset, src, dst, w``; ``w`` is 1 for a relation within days.

    ``tile`` sets how large keys are dealt to tasks. The result does not depend on it. The members are
    written first, as they are counted and then joined with themselves.
    """
    relation = with_members(relation)
    if relation.days is not None:
        return _pairs_within_days(relation, tile)
    met = _gathered(lists_in_groups(relation.members, relation.keys, relation.node, tile=tile), relation)
    # where another value starts; up to the next start, all are equal
    starts = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda k: (k == 0) | (F.get("all", k) != F.get("all", k - 1)))

    def counted(start: Column, place: Column) -> Column:
        end = F.coalesce(F.get("starts", place + 1), F.size("all"))
        return F.struct(F.get("all", start).alias("dst"), (end - start).cast("bigint").alias("w"))

    return met.withColumn("starts", starts).select("dataset", "src", F.inline(F.transform("starts", counted)))


def count_pairs(relation: Relation, tile: int = TILE, rounds: int = 1) -> DataFrame:
    """``dataset, pairs``: the number of rows of ``pairs``, which are not written out for it.

    With more ``rounds``, the nodes are parted by a hash and one part after the other is counted, so that
    much fewer lists are shuffled at once.
    """
    relation = with_members(relation)
    if relation.days is None:
        lists = lists_in_groups(relation.members, relation.keys, relation.node, tile=tile)
    else:
        lists = _lists_within_days(relation, tile)
    others = F.size(F.array_distinct(F.flatten(F.collect_list("to")))).cast("bigint").alias("n")

    def counted(part: DataFrame) -> DataFrame:
        each = _dealt(part, relation).groupBy("dataset", "src", "salt").agg(others)
        return each.groupBy("dataset").agg(F.sum("n").alias("pairs"))

    if rounds == 1:
        return counted(lists)
    # another hash than those that deal rows to tasks
    part = F.pmod(F.xxhash64(F.lit("round"), "dataset", "src"), F.lit(rounds))
    parts = [materialize(counted(lists.where(part == k)), "pairs-counted") for k in range(rounds)]
    return reduce(DataFrame.unionByName, parts).groupBy("dataset").agg(F.sum("pairs").alias("pairs"))


def _gathered(lists: DataFrame, relation: Relation) -> DataFrame:
    """``dataset, src, all``: what the lists of a node hold, in order, in one row of those that ``_dealt`` makes."""
    dealt = _dealt(lists, relation).groupBy("dataset", "src", "salt")
    return dealt.agg(F.sort_array(F.flatten(F.collect_list("to"))).alias("all"))


def _dealt(lists: DataFrame, relation: Relation) -> DataFrame:
    """``dataset, src, salt, to``: the lists, dealt out by the first three.

    Lists go to the tasks of their node, so no pair is shuffled as a row. A node in more keys than one task's
    share of the members has as many rows as it has such shares, each with its part of the others.
    """
    node, salts = relation.node, F.col("salts")
    hot = F.broadcast(hot_keys(relation.members.select("dataset", node), ["dataset", node]))
    placed = lists.withColumn("key_hash", F.xxhash64("dataset", "src")).join(hot, "key_hash", "left")
    placed = placed.select(
        "dataset", "src", "to", "salts", F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1)).alias("salt")
    )
    of_salt = F.filter("to", lambda y: F.pmod(F.xxhash64(y), F.col("salts")) == F.col("salt"))
    placed = placed.select("dataset", "src", "salt", F.when(salts.isNull(), F.col("to")).otherwise(of_salt).alias("to"))
    # dealt out first, as lists do not shrink when they are joined
    return placed.where(F.size("to") > 0).repartition("dataset", "src", "salt")


def _pairs_within_days(relation: Relation, tile: int) -> DataFrame:
    met = _gathered(_lists_within_days(relation, tile), relation)
    return met.select("dataset", "src", F.explode(F.array_distinct("all")).alias("dst")).withColumn(
        "w", F.lit(1).cast("bigint")
    )


def _lists_within_days(relation: Relation, tile: int) -> DataFrame:
    """The lists of larger members that each meets, key by key. The members of a key with few are compared all. Those of a larger one are parted by a
    calendar cut into blocks of ``days``, so the partner of a row lies in its own block or
    a neighbouring one. Each row is a ``home`` row of its own block and a guest of the next: a pair
    meets in one block, and two guests are left to the block where both are at home.
    """
    days, keys, node = relation.days, relation.keys, relation.node
    members = relation.members.select(*keys, node, "day")

    def near(x: Column, y: Column) -> Column:
        return F.abs(x.getField("day") - y.getField("day")) <= days

    def in_block(x: Column, y: Column) -> Column:
        return near(x, y) & (x.getField("home") | y.getField("home"))

    large = materialize(group_sizes(members, keys, min(tile, FEW)).select(*keys), "keys-in-time")
    if large.isEmpty():
        return lists_in_groups(members, keys, node, near, tile)
    block = F.floor(F.col("day") / days).cast("int")
    blocks = F.array(
        F.struct(block.alias("block"), F.lit(True).alias("home")),
        F.struct((block + 1).alias("block"), F.lit(False).alias("home")),
    )
    many = join_spread(members, large, keys, [node], "left_semi")
    many = many.select(*keys, node, "day", F.explode(blocks).alias("x")).select(*keys, "x.block", node, "day", "x.home")
    few = join_spread(members, large, keys, [node], "left_anti")
    met = lists_in_groups(many, [*keys, "block"], node, in_block, tile).drop("block")
    return met.unionByName(lists_in_groups(few, keys, node, near, tile))


def runs(relation: Relation) -> Relation:
    """A relation without days that has the same connected nodes.

    In a key, days at most ``days`` apart from the next one follow on another without a gap: they are a
    run, and its members hang together, each with the next in time. A gap parts them. So the key and
    the number of the run are the keys of the new relation. Only the distinct days of a
    key are put in order, and a calendar has few. The members are written first, as they are read three times.
    """
    if relation.days is None:
        return relation
    relation = with_members(relation)
    run = next(n for n in ("run", "run_of_days") if n not in relation.members.columns)
    in_time = Window.partitionBy(*relation.keys).orderBy("day")
    days = relation.members.select(*relation.keys, "day").distinct()
    gap = F.col("day") - F.lag("day").over(in_time) > relation.days
    days = days.withColumn("gap", F.coalesce(gap, F.lit(False)).cast("int"))
    days = days.select(*relation.keys, "day", F.sum("gap").over(in_time).alias(run))
    members = join_spread(relation.members, days, [*relation.keys, "day"], [relation.node])
    keys = [*relation.keys, run]
    return Relation(members.select(*keys, relation.node).distinct(), keys, relation.node)


class TextOverlap:
    """``classes`` and ``pairs``; the pairs are looked for when they are first asked for."""

    def __init__(self, classes: DataFrame, found: Callable[[], DataFrame]):
        self.classes, self._found = classes, found

    @cached_property
    def pairs(self) -> DataFrame:
        return self._found()


def text_overlap(documents: DataFrame, percent: int = 50, tile: int = TILE) -> TextOverlap:
    """Texts whose token sets have at least ``percent`` of their union in common.

    ``classes`` says for each text which text stands for its token set: the smallest id with equal
    tokens, so copies make no pairs. ``pairs`` holds ``src < dst`` of those, with ``w`` the shared tokens.
    A text without tokens has no class.

    All tokens count. Candidates are exact: with the tokens of a set in order of rarity, two sets that
    must share t tokens share k of the first ``n - ceil(percent n) + k`` of each, and at least t - k + 1 of each
    follow from any of those k on. So only those are joined, and pairs with k of them are compared on
    whole sets. One shared rare token is common among long texts and several are not, so k grows with the
    smaller set (``_first``).
    Another text changes which tokens are joined on, and never takes a pair away. The token sets are
    written once, and for the pairs once more as numbers; the pairs are a written table, and what was
    written for them is gone then.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    kept = F.sort_array(F.array_remove(F.array_distinct(tokens(F.col("text"))), ""))
    sets = documents.select("doc_id", kept.alias("tokens")).where("doc_id IS NOT NULL AND size(tokens) > 0")
    sets = materialize(sets.withColumn("set", F.sha2(F.array_join("tokens", " "), 256)), "token-sets")
    first = sets.groupBy("set").agg(F.min("doc_id").alias("id"))
    classes = materialize(join_spread(sets.select("doc_id", "set"), first, ["set"], ["doc_id"]), "text-classes")
    return TextOverlap(
        classes.select("doc_id", F.col("id").alias("class_id")), lambda: _alike(sets, classes, percent, tile)
    )


def _alike(sets: DataFrame, classes: DataFrame, percent: int, tile: int) -> DataFrame:
    """The pairs of ``text_overlap``, from its written token sets and classes.

    A set is named by its id and size. What only one step reads goes when that step has ended, the token sets too.
    """
    spark = sets.sparkSession
    own = classes.where(F.col("doc_id") == F.col("id")).distinct()
    # rows that repeat an id and a set lie together after the join, so whole sets are moved once
    stands = sets.join(own, ["doc_id", "set"]).groupBy("doc_id", "set").agg(F.first("tokens").alias("tokens"))
    texts = materialize(stands.select(F.col("doc_id").alias("id"), F.size("tokens").alias("n"), "tokens"), "texts")
    discard(spark, sets.scratch)
    coded = step(spark, lambda: _by_rarity(texts), "rare-tokens")
    discard(spark, texts.scratch)
    places = materialize(_rarest(coded, percent), "rare-places")
    found = materialize(_candidates(places, percent, tile), "alike-candidates")
    discard(spark, places.scratch)
    x, y = (coded.select(*(F.col(c).alias(f"{c}_{end}") for c in ("id", "n", "rare"))) for end in ("src", "dst"))
    shared = F.size(F.array_intersect("rare_src", "rare_dst")).cast("bigint")
    both = F.col("n_src") + F.col("n_dst")
    compared = (
        found.join(x, ["id_src", "n_src"])
        .join(y, ["id_dst", "n_dst"])
        .select(F.col("id_src").alias("src"), F.col("id_dst").alias("dst"), shared.alias("w"), both.alias("both"))
        .where(F.col("w") * 100 >= (F.col("both") - F.col("w")) * percent)
    )
    alike = materialize(compared.select("src", "dst", "w"), "alike")
    discard(spark, coded.scratch)
    return alike


def _rarest(coded: DataFrame, percent: int) -> DataFrame:
    """``id, n, at, key``: the rarest tokens of each set, with their places; those in no other text keep theirs."""
    need = F.expr(f"(n * {percent} + 99) div 100").cast("int")
    alone = F.greatest(F.col("n") - F.size("rare"), F.lit(0))
    joined = F.greatest(F.col("n") - need + _first(F.col("n")) - alone, F.lit(0))
    places = coded.select("id", "n", alone.alias("alone"), F.posexplode(F.slice("rare", F.lit(1), joined)).alias("at", "key"))
    return places.select("id", "n", (F.col("at") + F.col("alone")).alias("at"), "key")


def _candidates(places: DataFrame, percent: int, tile: int) -> DataFrame:
    """The ids and sizes of sets that meet on enough of their rarest tokens."""
    a, b = F.col("a"), F.col("b")
    first = _first(F.least(a.n, b.n))
    after = F.least(a.n - a["at"], b.n - b["at"])  # tokens that both may share from here on
    wanted = (a.id < b.id) & ((after + first - 1) * (100 + percent) >= (a.n + b.n) * percent)
    met = pairs_in_groups(places, ["key"], "id", wanted, tile)
    met = met.groupBy(
        a.id.alias("id_src"), b.id.alias("id_dst"), a.n.alias("n_src"), b.n.alias("n_dst")
    ).agg(F.count("*").alias("k"))
    both = F.col("n_src") + F.col("n_dst")
    enough = (F.col("k") >= _first(F.least("n_src", "n_dst"))) | (F.col("k") * (100 + percent) >= both * percent)
    return met.where(enough).drop("k")


def _first(n: Column) -> Column:
    """How many of its first shared tokens a set of ``n`` must meet another one on: one, and more with its size."""
    return F.least(F.lit(1) + F.floor(n / LONG).cast("int"), F.lit(MET))


def _by_rarity(texts: DataFrame) -> DataFrame:
    """``id, n, rare``: the tokens of each set that another text has too, as numbers, the rarest first.

    A token has one number and a number one token, so sets of numbers share as many as the sets of tokens. Sets
    without such a token are left out. Tokens of very many texts are spread over tasks.
    """
    spark = texts.sparkSession
    each = texts.select("id", "n", F.explode("tokens").alias("token"))
    numbers = step(spark, lambda: _numbers(each.groupBy("token").agg(F.count("*").alias("texts"))), "token-numbers")
    most = numbers.agg(F.max("rare")).first()[0] or 0
    numbers = numbers.withColumn("rare", F.col("rare").cast("int" if most < 2**31 else "bigint"))
    numbered = join_spread(each, numbers, ["token"], ["id"]).drop("token")
    return numbered.groupBy("id", "n").agg(F.sort_array(F.collect_list("rare")).alias("rare"))


def _numbers(counts: DataFrame) -> DataFrame:
    """``token, rare``: the tokens of several texts, numbered without a gap, those of the fewest texts first."""
    parts = partitions(counts)
    alike = F.least("texts", F.lit((1 << RARE_BITS) - 1)).alias("texts")
    shared = counts.where(F.col("texts") > 1).select("token", alike, F.xxhash64("token").alias("order"))
    placed = shared.repartitionByRange(parts, "texts", "order").sortWithinPartitions("texts", "order")
    placed = materialize(placed.select("token", F.monotonically_increasing_id().alias("place")), "placed-tokens")
    part, low = F.shiftright("place", ROW_BITS).alias("part"), (1 << ROW_BITS) - 1
    placed = placed.select("token", part, F.col("place").bitwiseAND(F.lit(low)).alias("row"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count("*").alias("rows"))  # a row per partition
    starts = starts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").select("token", (F.col("start") + F.col("row")).alias("rare"))


def union_members(relations: dict[str, Relation]) -> DataFrame:
    """The members of all relations: ``dataset, relation, key`` (as text), ``node, day``.

    Each is distinct and has its own name, so the union is distinct as it stands: no shuffle.
    """

    def part(name: str, relation: Relation) -> DataFrame:
        day = F.col("day") if relation.days is not None else F.lit(None).cast("int")
        return relation.members.select(
            "dataset",
            F.lit(name).alias("relation"),
            F.concat_ws(":", *relation.keys[1:]).alias("key"),
            F.col(relation.node).alias("node"),
            day.alias("day"),
        )

    return reduce(DataFrame.unionByName, [part(n, r) for n, r in relations.items()])


def union_pairs(relations: dict[str, DataFrame]) -> DataFrame:
    """Pair tables as one ``edges`` table: ``dataset, relation, src, dst, w``."""
    parts = [
        found.select("dataset", F.lit(name).alias("relation"), "src", "dst", "w")
        for name, found in relations.items()
    ]
    return reduce(DataFrame.unionByName, parts)
