"""Exact deduplication against an index of known digests, a minimal perfect hash per shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, without_rows

SHARD = 8192  # digests that a shard holds on average
LOAD = 1.6  # bits per key in each level
LEVELS = 64
BROADCAST_ROWS = 500_000  # rows that go, broadcast at most
INDEX = "shard bigint, sizes array<bigint>, bits binary, digests binary, winners array<bigint>, counts array<bigint>"
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def digest(text: Column) -> Column:
    """The 32 bytes of the SHA-256 of the normalised text."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class PerfectHash:
    """Minimal perfect hash by levels of bits.

    Level l gives each key left over one bit; a key alone on its bit stays there, the others go on.
    The slot of a key is the number of set bits before its own. Keys that no level parted, which
    takes digests with equal halves, have the last slots and are found by their bytes.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @staticmethod
    def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = words[:, 0] + words[:, 1] * np.uint64(2 * level + 1)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(32)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], np.arange(len(words))
        while len(left) and len(sizes) < LEVELS:
            size = max(1, int(LOAD * len(left)))
            at = cls._place(words[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Slot of each key; of one that was not built in any slot, or -1."""
        slot, left, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = base + self._place(words[left], level, size)
            hit = self.bits[at]
            slot[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + size
        return slot


def _words(digests: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(map(bytes, digests)), np.uint8).reshape(-1, 32)
    return raw, raw.view("<u8").reshape(-1, 4)


def _build_shard(keys: pd.DataFrame) -> pd.DataFrame:
    raw, words = _words(keys["digest"])
    hashed = PerfectHash.build(words)
    slot = hashed.slots(words)
    slot[slot < 0] = hashed.rank[-1] + np.arange((slot < 0).sum())
    order = np.argsort(slot)
    winners = [None if pd.isna(w) else int(w) for w in keys["winner"].iloc[order]]
    return pd.DataFrame(
        {
            "shard": [keys["shard"].iloc[0]],
            "sizes": [hashed.sizes],
            "bits": [np.packbits(hashed.bits).tobytes()],
            "digests": [raw[order].tobytes()],
            "winners": [winners],
            "counts": [keys["n"].to_numpy()[order].tolist()],
        }
    )


def _look_up(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """The asked digests with what the index says; ``known`` only where all 32 bytes are equal."""
    slot = np.full(len(asked), -1, np.int64)
    winner = np.full(len(asked), None, object)
    known = np.zeros(len(asked), bool)
    if len(index) and len(asked):
        row = index.iloc[0]
        sizes = [int(s) for s in row["sizes"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(sizes)].astype(bool)
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        raw, words = _words(asked["digest"])
        hashed = PerfectHash(sizes, bits)
        slot = hashed.slots(words)
        hit = slot >= 0
        known[hit] = (held[slot[hit]] == raw[hit]).all(axis=1)
        tail = {held[s].tobytes(): s for s in range(int(hashed.rank[-1]), len(held))}
        for n in np.flatnonzero(~known) if tail else ():
            if (s := tail.get(raw[n].tobytes())) is not None:
                slot[n], known[n] = s, True
        winners = np.array(list(row["winners"]), object)
        winner[known] = winners[slot[known]]
    out = asked[["digest", "first", "n"]].copy()
    out["known"], out["winner"], out["slot"] = known, winner, np.where(known, slot, -1)
    return out


def _groups(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Groups of a shard: one for each slot, with the rows that the look-up gave it, and one for
    each asked digest that the index does not know."""
    found = _look_up(asked, index)
    known = found["known"].to_numpy(bool)
    new = found[~known]
    digests, keep, sizes = list(new["digest"]), list(new["first"]), list(new["n"])
    if len(index):
        row = index.iloc[0]
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        counts = np.array(list(row["counts"]), np.int64)
        np.add.at(counts, found["slot"].to_numpy()[known], found["n"].to_numpy()[known])
        digests += [d.tobytes() for d in held]
        keep += list(row["winners"])
        sizes += counts.tolist()
    keep = [None if pd.isna(k) else int(k) for k in keep]
    return pd.DataFrame({"digest": digests, "keep_id": pd.array(keep, "Int64"), "group_size": sizes})


def _by_shard(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("bigint"))


def build_index(distinct: DataFrame, shards: int) -> DataFrame:
    """Index rows, one for each shard, from distinct (digest, winner, n)."""
    return _by_shard(distinct, shards).groupBy("shard").applyInPandas(_build_shard, INDEX)


def look_up(index: DataFrame, distinct: DataFrame, shards: int) -> DataFrame:
    """Groups (digest, keep_id, group_size) from the index and distinct (digest, first, n).

    The look-up decides: a known digest adds its rows to its slot, whose winner stays, and an
    unknown one is a group of its own. Nothing is grouped by digest after that.
    """
    return (
        _by_shard(distinct, shards)
        .groupBy("shard")
        .cogroup(index.groupBy("shard"))
        .applyInPandas(_groups, "digest binary, keep_id bigint, group_size bigint")
    )


def dedupe(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256. Null texts count as empty.

    The older half of the ids is history: its distinct digests go into the index, each slot with the
    whole digest and the smallest id. Of the newer half (and rows without an id) distinct digests
    are looked up; known ones join the group of their slot, the others are groups of their own.
    Both sides are aggregated before they are shuffled, so a text that a third of all rows share is
    one row in its shard, and a shard has about ``shard`` digests at any size of the input. Only ids
    and digests are shuffled, no texts.

    Rows that repeat an id and text count each, and are kept or dropped together. A group whose ids
    are all null has a null keep_id and is kept. Extra columns are ignored.
    """
    ids = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text")).alias("digest")
    )
    ids = materialize(ids, "digests")
    ends = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    middle = (ends[0] + ends[1]) // 2 if ends[0] is not None else 0
    shards = max(1, -(-ends[2] // (2 * shard)))
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    history = materialize(
        ids.filter(old).groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count("*").alias("n")),
        "history",
    )
    index = materialize(build_index(history, shards), "index")
    new = ids.filter(~old).groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    groups = look_up(index, new, shards)
    return ids.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each group of equal normalised texts.

    It has the smallest id; of rows that repeat that id, or if all ids are null, any one stays. Rows
    that go or repeat are named by id and digest and counted; they are broadcast if few, else the
    joins shuffle.
    """
    named = dedupe(docs).groupBy("doc_id", "text_sha256").agg(
        F.bool_and("kept").alias("kept"), F.count("*").alias("n")
    )
    named = named.filter(~F.col("kept") | (F.col("n") > 1)).select(
        F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("text"), (~F.col("kept")).alias("gone")
    )
    named = materialize(named, "copies")
    key = digest(F.col("text"))
    return without_rows(docs, named, F.col("doc_id").cast("bigint"), key, key, BROADCAST_ROWS)
