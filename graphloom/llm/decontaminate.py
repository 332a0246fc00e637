"""Benchmark decontamination: word windows of the items, looked up in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, checked_broadcast, fresh, materialize

WIDTH = 10
BROADCAST_ROWS = 500_000  # windows that are broadcast at most; more go through a shuffle
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, a-z and everything beyond ASCII, after A-Z became lower case."""
    parts = F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def grams(tokens: Column, width: Column) -> Column:
    """Array of (at, width, gram): each run of ``width`` words, joined by blanks."""
    starts = F.when(F.size(tokens) >= width, F.sequence(F.lit(1), F.size(tokens) - width + 1))
    return F.transform(
        F.coalesce(starts, F.array().cast("array<int>")),
        lambda at: F.struct(
            at.alias("at"), width.alias("width"), F.array_join(F.slice(tokens, at, width), " ").alias("gram")
        ),
    )


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct (item_id, width, gram). An item of fewer words is one window, one of none has none."""
    tokens = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    tokens = tokens.filter((F.size("w") > 0) & F.col("item_id").isNotNull())
    found = F.explode(grams(F.col("w"), F.least(F.size("w"), F.lit(width))))
    return tokens.select("item_id", found.alias("g")).select("item_id", "g.width", "g.gram").distinct()


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Every place (key, at, width, item_id) where a window occurs in a document.

    ``docs`` has a ``key`` and ``text``. The words of a gram themselves are the join key, so a hit
    needs no further check. The set of windows is broadcast if its count allows, else both sides are
    shuffled by gram. Items have few lengths, at most ``WIDTH``, so those are collected.
    """
    sizes = windows.groupBy("width").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return docs.select("key", F.lit(0).alias("at"), F.lit(0).alias("width"), F.lit("").alias("item_id")).limit(0)
    held = checked_broadcast(windows, sum(r["n"] for r in sizes), BROADCAST_ROWS)
    tokens = docs.select("key", words(F.col("text")).alias("w"))
    arrays = [grams(F.col("w"), F.lit(r["width"])) for r in sizes]
    each = tokens.select("key", F.explode(F.concat(*arrays)).alias("g")).select("key", "g.*")
    return each.join(held, ["gram", "width"]).select("key", "at", "width", "item_id")


def _key(text: Column) -> Column:
    """Stands for a whole text: two hashes and the length."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.struct(
        F.xxhash64(t).alias("hash"), F.crc32(t.cast("binary")).alias("crc"), F.octet_length(t).alias("size")
    )


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and
    ``spans``, the hit places as merged (first, last) word numbers from 1.

    Hits are gathered by a key of the whole text, so rows with equal texts share one result whatever
    their ids, and a text that a third of all rows repeat is one small group. A null or empty text
    has no words. An empty ``benchmark`` hits nothing.
    """
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text"), _key(F.col("text")).alias("key"))
    found = hits(keyed, item_windows(benchmark, width))
    place = F.struct("at", (F.col("at") + F.col("width") - 1).alias("to"))
    per_text = found.groupBy("key").agg(
        F.array_sort(F.collect_set(place)).alias("places"), F.array_sort(F.collect_set("item_id")).alias("items")
    )
    per_text = per_text.select("key", "items", _merged("places").alias("spans"))
    sized = keyed.select("doc_id", "key", F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    spans = F.coalesce("spans", F.array().cast("array<struct<at:int,to:int>>"))
    out = sized.join(per_text, "key", "left").select("doc_id", "n_words", items.alias("items"), spans.alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["to"] - s["at"] + 1)
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "spans",
    )


def _merged(places: str) -> Column:
    """Sorted places with those that touch or overlap made one."""

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["at"].alias("at"), F.greatest(last["to"], x["to"]).alias("to"))
        touches = (F.size(done) > 0) & (x["at"] <= F.try_element_at(done, F.lit(-1))["to"] + 1)
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(x))
        )

    return F.aggregate(places, F.array().cast("array<struct<at:int,to:int>>"), step)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs``, all columns, without the rows whose text holds a window of an item.

    The keys of hit texts are written and counted; they are broadcast if few, else the anti join
    shuffles.
    """
    key, name = _key(F.col("text")), fresh("dirty", docs)
    found = hits(docs.select(key.alias("key"), F.col("text").cast("string").alias("text")), item_windows(benchmark, width))
    dirty = materialize(found.select(F.col("key").alias(name)).distinct(), "hits")
    dirty = checked_broadcast(dirty, dirty.count(), BROADCAST_ROWS)
    return docs.join(dirty, key == F.col(name), "left_anti")
