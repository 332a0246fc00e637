"""Removal of repeated runs of lines, by prefix doubling over the sequences of lines.

A place is a line of a document. Level k names, for each place, the run of 2^k lines that starts
there: its name is the first place, in order of document and line, where that run occurs. Level k+1
is level k joined with itself 2^k lines further on. Only places whose run occurs more than once are
kept, so levels shrink fast. Equal names are the equivalence classes that a suffix array sorted to
that depth would have, and the smallest member is all that the removal asks of a class.

Then each place descends the levels from the longest and finds its longest run that also occurs at
an earlier place: the common-prefix interval in which it is not the first. Such runs of enough words
are later copies, and their lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.llm.common import checked_broadcast, fresh, materialize

WORDS = 50  # words that a repeated run has at least
BROADCAST_ROWS = 500_000  # texts with removed lines that are broadcast at most


def _doc() -> Column:
    """Stands for a document: its id, and its text, as rows may repeat an id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.struct(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text).alias("text"))


def _further(name: str, by: Column | int) -> Column:
    """The place ``by`` lines after the place in a column."""
    place = F.col(name)
    return F.struct(place["doc"].alias("doc"), (place["line"] + by).alias("line"))


def places(docs: DataFrame) -> DataFrame:
    """(place, words, name) of all lines that occur more than once."""
    lines = docs.select(_doc().alias("doc"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line", "content"))
    lines = lines.select(
        F.struct("doc", "line").alias("place"),
        F.size(F.filter(F.split("content", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("words"),
        F.unhex(F.md5(F.col("content").cast("binary"))).alias("digest"),
    )
    lines = materialize(lines.distinct(), "lines")
    names = lines.groupBy("digest").agg(F.min("place").alias("name"), F.count("*").alias("n")).filter("n > 1")
    return materialize(lines.join(names, "digest").select("place", "words", "name"), "level")


def levels(first: DataFrame) -> list[DataFrame]:
    """(place, name) for runs of 1, 2, 4, ... lines, as long as any occurs more than once."""
    made = [first.select("place", "name")]
    while True:
        now, step = made[-1], 2 ** (len(made) - 1)
        later = now.select(_further("place", -step).alias("place"), F.col("name").alias("then"))
        pairs = materialize(now.join(later, "place"), "pairs")
        names = pairs.groupBy("name", "then").agg(F.min("place").alias("new"), F.count("*").alias("n")).filter("n > 1")
        up = materialize(pairs.join(names, ["name", "then"]).select("place", F.col("new").alias("name")), "level")
        if up.isEmpty():
            return made
        made.append(up)


def longest_earlier(made: list[DataFrame]) -> DataFrame:
    """(place, size): lines of the longest run from a place that an earlier place starts too.

    A run that is accepted has a first place. The next one down extends it if it agrees with the
    one at that first place, or with the one at an earlier place that took the same steps.
    """
    none = F.lit(None).cast(made[0].schema["name"].dataType)
    state = made[0].select("place", F.lit(0).alias("size"), none.alias("first"))
    for k in range(len(made) - 1, -1, -1):
        level = made[k]
        here = level.select(F.col("place").alias("at"), F.col("name").alias("mine"))
        there = level.select(F.col("place").alias("from"), F.col("name").alias("theirs"))
        asked = state.withColumn("at", _further("place", F.col("size"))).withColumn("from", _further("first", F.col("size")))
        asked = asked.join(here, "at", "left").join(there, "from", "left")
        asked = materialize(asked.select("place", "size", "first", "mine", "theirs"), "steps")
        group = F.struct("first", "size", "mine").alias("group")
        ended = asked.filter("mine IS NULL").select("place", "size", "first")
        asked = asked.filter("mine IS NOT NULL").withColumn("group", F.struct("first", "size", "mine"))
        low = asked.groupBy("group").agg(F.min("place").alias("low"))
        asked = asked.join(low, "group")
        as_first = F.coalesce(F.col("mine") == F.col("theirs"), F.lit(False))
        accepted = as_first | (F.col("low") < F.col("place"))
        state = asked.select(
            "place",
            F.when(accepted, F.col("size") + 2**k).otherwise(F.col("size")).alias("size"),
            F.when(as_first | ~accepted, F.col("first")).otherwise(F.col("low")).alias("first"),
        ).unionByName(ended)
        state = materialize(state, "state")
    return state.select("place", "size")


def removed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc, ranges): per document the first and last numbers, from 0, of lines that go."""
    first = places(docs)
    runs = longest_earlier(levels(first))
    by_doc = Window.partitionBy("place.doc").orderBy("place.line").rowsBetween(Window.unboundedPreceding, 0)
    known = first.select("place", F.sum("words").over(by_doc).alias("until"), "words")
    known = materialize(known, "words")
    ends = known.select(F.col("place").alias("end"), F.col("until").alias("until_end"))
    spans = (
        runs.filter("size > 0").join(known, "place")
        .withColumn("end", _further("place", F.col("size") - 1))
        .join(ends, "end")
        .filter(F.col("until_end") - F.col("until") + F.col("words") >= words)
        .select("place", F.col("end")["line"].alias("last"))
    )
    covered = known.select("place").join(spans, "place", "left")
    covered = covered.withColumn("reach", F.max("last").over(by_doc)).filter(F.col("reach") >= F.col("place")["line"])
    order = Window.partitionBy("place.doc").orderBy("place.line")
    covered = covered.withColumn("run", F.col("place")["line"] - F.row_number().over(order))
    parts = covered.groupBy(F.col("place")["doc"].alias("doc"), "run").agg(
        F.min(F.col("place")["line"]).alias("first"), F.max(F.col("place")["line"]).alias("last")
    )
    return parts.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges"))


def dedupe(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` without the lines of later copies, and ``n_removed``, the lines that went.

    A run goes if it occurs at an earlier place, has ``words`` words or more, and each of its lines
    is equal byte for byte. Order is by doc_id, then line; within a document too. So of a document
    that is a whole copy nothing is left but an empty text. Rows that repeat id and text are one
    document and lose the same lines. A null text stays null. Rows without an id come first. All
    other columns stay; ``n_removed`` replaces a column of that name.
    """
    key, doc, ranges = (fresh(name, docs) for name in ("key_of_doc", "doc", "ranges"))
    gone = materialize(removed(docs, words), "removed").select(F.col("doc").alias(doc), F.col("ranges").alias(ranges))
    gone = checked_broadcast(gone, gone.count(), BROADCAST_ROWS)
    out = docs.withColumn(key, _doc())
    out = out.join(gone, F.col(key).eqNullSafe(F.col(doc)), "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    kept = F.filter(lines, lambda _, k: ~F.exists(ranges, lambda r: k.between(r["first"], r["last"])))
    n = F.aggregate(ranges, F.lit(0).cast("bigint"), lambda total, r: total + r["last"] - r["first"] + 1)
    return (
        out.withColumn("text", F.when(F.col(ranges).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .withColumn("n_removed", F.coalesce(n, F.lit(0).cast("bigint")))
        .drop(key, doc, ranges)
    )


def op1(docs: DataFrame) -> DataFrame:
    """All rows with the lines left of them; cases as in ``dedupe``."""
    return dedupe(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
