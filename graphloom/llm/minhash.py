"""Near-duplicate groups by MinHash signatures and a multi-index Hamming join.

1. Each text becomes a set of shingles and a signature, in the scan task. Equal sets become one.
2. Signatures are cut into pieces; each piece gives keys that allow for one differing symbol, so by
   the pigeonhole rule two signatures within ``RADIUS`` share a key (``keys``).
3. Keys are aggregated to their smallest and largest member and their count. The smallest member of a
   key is compared with each other member; links are confirmed on the full sets and united.
4. Pairs that were never compared and are not united yet can only lie in keys of three members or
   more that still hold several components. Members of those are laid out in blocks of bounded size,
   and each pair of blocks that have a key in common is one task, which compares longer signatures
   in arrays and gives out only pairs within ``WIDE_RADIUS``. Those are confirmed on the full sets.

So a group of copies is never expanded into its pairs, and no key is left out, however hot it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType

from graphloom.llm.common import checked_broadcast, materialize, small_batches, without_rows
from graphloom.llm.components import components
from graphloom.operators.hot import join_spread

WORDS = 5  # words of a shingle
SYMBOLS = 128  # symbols of a signature
BITS = 16  # bits of a symbol
CHUNKS = 27  # pieces that a signature is cut into
ERRORS = 1  # symbols that may differ within a piece
RADIUS = CHUNKS * (ERRORS + 1) - 1  # symbols that may differ over all
WIDE = 512  # symbols of the longer signature, of 8 bits each
WIDE_RADIUS = 174  # of those may differ: 128 are expected at the threshold, deviation 10
BLOCK = 256  # documents of a block on average
BROADCAST_ROWS = 1_000_000  # ids or keys that are broadcast at most
THRESHOLD = 75  # percent

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_POWERS = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(0, 2**31, WIDE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, WIDE, dtype=np.uint32)
_CUTS = np.linspace(0, SYMBOLS, CHUNKS + 1).round().astype(int)
_known: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The set of a text: sorted distinct 64-bit hashes of its runs of five words.

    Fewer words are one run, no words an empty set. Words lie between ASCII white space, which is
    what ``bytes.split`` and ``bytes.lower`` go by.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_known) > 150_000:
        _known.clear()
    for w in words:
        if w not in _known:
            _known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out += _mixed(h[k : len(h) - size + 1 + k]) * _POWERS[k]
        out = _mixed(out + np.uint64(size))
    return np.unique(out)


def smallest(values: np.ndarray, symbols: int) -> np.ndarray:
    """For each of ``symbols`` hash functions the smallest hash in the set, stirred once more."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    best = np.full(symbols, 0xFFFFFFFF, np.uint32)
    a, b = _A[:symbols, None], _B[:symbols, None]
    for start in range(0, len(low), 2048):
        with np.errstate(over="ignore"):
            hashed = low[None, start : start + 2048] * a + b
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        np.minimum(best, hashed.min(axis=1), out=best)
    return best ^ (best >> np.uint32(13))


def signature(values: np.ndarray) -> np.ndarray:
    return (smallest(values, SYMBOLS) & np.uint32((1 << BITS) - 1)).astype(np.uint16)


def wide_signature(values: np.ndarray) -> np.ndarray:
    return (smallest(values, WIDE) & np.uint32(255)).astype(np.uint8)


def keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of each signature: two that differ in at most ``RADIUS`` symbols share one.

    Some piece then has at most ``ERRORS`` of the differing symbols, so that both have the same
    symbols there with one place left out. Each place of each piece left out in turn is one key.
    """
    wide = signatures.astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for c in range(CHUNKS):
            places = range(_CUTS[c], _CUTS[c + 1])
            for gone in places:
                key = np.full(len(wide), (gone + 1) * 0x9E37, np.uint64)
                for p in places:
                    if p != gone:
                        key = _mixed(key * np.uint64(0x100000001B3) + wide[:, p] + np.uint64(1))
                out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether two sorted sets have at least ``threshold`` percent of their union in common."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * common >= threshold * (len(a) + len(b) - common)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sizes, hashes, signs = [], [], []
            for text in part["text"].to_pylist():
                values = shingles(text)
                sizes.append(len(values))
                hashes.append(xxhash.xxh3_128_digest(values.tobytes()))
                signs.append(signature(values).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    part["text_hash"],
                    pa.array(sizes, pa.int64()),
                    pa.array(hashes, pa.binary()),
                    pa.array(signs, pa.binary()),
                ],
                ["doc_id", "text_hash", "n", "set_hash", "sign"],
            )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            signs = np.frombuffer(b"".join(part["sign"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            ids = np.repeat(part["id"].to_numpy(zero_copy_only=False), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys(signs).ravel()), pa.array(ids)], ["key", "id"])


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = [shingles(t) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part["id"],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                    pa.array([wide_signature(s).tobytes() for s in sets], pa.binary()),
                    pa.array([smallest(s, SYMBOLS).tobytes() for s in sets], pa.binary()),
                ],
                ["id", "n", "shingles", "wide", "least"],
            )


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each hash function of a document: the function and its smallest hash, in one number."""
    number = np.arange(SYMBOLS, dtype=np.int64) << 32
    for batch in batches:
        least = np.frombuffer(b"".join(batch["least"].to_pylist()), np.uint32).reshape(-1, SYMBOLS)
        ids = np.repeat(batch["id"].to_numpy(zero_copy_only=False), SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array((least + number).ravel()), pa.array(ids)], ["spot", "id"])


@F.pandas_udf(IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    out = [
        int((np.frombuffer(x, np.uint16) != np.frombuffer(y, np.uint16)).sum()) for x, y in zip(a, b)
    ]
    return pd.Series(out, dtype="int32")


@F.pandas_udf(BooleanType())
def _confirmed(a: pd.Series, b: pd.Series) -> pd.Series:
    out = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)]
    return pd.Series(out, dtype=bool)


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a tile, from different components and blocks, that the longer signatures allow."""
    blocks = rows["block"].unique()
    first, second = blocks.min(), blocks.max()
    left, right = rows[rows["block"] == first], rows[rows["block"] == second]
    x = np.frombuffer(b"".join(map(bytes, left["wide"])), np.uint8).reshape(-1, WIDE)
    y = np.frombuffer(b"".join(map(bytes, right["wide"])), np.uint8).reshape(-1, WIDE)
    ids, other = left["id"].to_numpy(), right["id"].to_numpy()
    n, m = left["n"].to_numpy(), right["n"].to_numpy()
    of, to = left["label"].to_numpy(), right["label"].to_numpy()
    found = []
    for k in range(len(left)):
        near = np.flatnonzero(
            (of[k] != to)
            & (100 * np.minimum(n[k], m) >= THRESHOLD * np.maximum(n[k], m))
            & ((ids[k] < other) if first == second else True)
        )
        near = near[(y[near] != x[k]).sum(axis=1) <= WIDE_RADIUS]
        found += [(min(ids[k], o), max(ids[k], o)) for o in other[near]]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _confirm(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """Those of the distinct pairs (a, b) that are linked by their full sets."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(a, "a").join(b, "b")
    return materialize(both.filter(_confirmed("set_a", "set_b")).select("a", "b"), label)


def _open(labelled: DataFrame) -> DataFrame:
    """Members, with the size of the key, of those keys that hold several components."""
    keys = labelled.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n_key")
    )
    return labelled.join(keys.filter("low < high").select("key", "n_key"), "key")


def _residual(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different components that may be linked, from keys of many members.

    A document of which more than ``RADIUS`` smallest hashes are those of no other document here has no
    partner within ``RADIUS`` left, and goes first: most meet by a passage that many texts share.

    The home of a document is the largest of its keys; a home is parted into blocks of about
    ``BLOCK`` documents. Each two blocks that share a key are one tile.
    """
    labelled = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    held = materialize(_open(labelled).select("key", "id", "label"), "held-members")
    ids = held.select("id").distinct()
    spots = sets.join(ids, "id", "left_semi").select("id", "least").mapInArrow(_spots, "spot bigint, id bigint")
    alone = spots.groupBy("spot").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last")
    lost = alone.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > RADIUS)
    left = materialize(_open(held.join(lost, "id", "left_anti")), "open-members")
    homes = left.groupBy("id").agg(F.max(F.struct("n_key", "key"))["key"].alias("home"), F.min("label").alias("label"))
    homes = materialize(homes, "homes")
    parts = homes.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    salt = F.pmod(F.xxhash64("id"), F.col("parts"))
    placed = homes.join(parts, "home").select("id", "label", F.xxhash64("home", salt).alias("block"))
    placed = materialize(placed, "blocks")
    seen = left.select("key", "id").join(placed.select("id", "block"), "id").select("key", "block").distinct()
    seen = materialize(seen, "key-blocks")
    tiles = (
        seen.join(seen.withColumnRenamed("block", "block2"), "key")
        .filter("block <= block2")
        .select("block", "block2")
        .distinct()
    )
    tile = F.struct(F.col("block").alias("i"), F.col("block2").alias("j")).alias("tile")
    ends = F.array_distinct(F.array("block", "block2"))
    wanted = tiles.select(tile, F.explode(ends).alias("block"))
    docs = placed.join(sets.select("id", "n", "wide"), "id")
    return (
        wanted.join(docs, "block")
        .select(F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), "block", "id", "label", "n", "wide")
        .groupBy("i", "j")
        .applyInPandas(_compare, "a bigint, b bigint")
        .distinct()
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, and text_hash, which names the text.

    Links are between documents whose sets have at least 75 percent of their union in common.
    ``component_id`` is the smallest id that links lead to. A null or blank text has an empty set
    and is linked with nothing. Rows without an id take no part: component null, kept. Rows that
    repeat an id are one document if their texts agree; else each has the component of its text.
    """
    clean = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = clean.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _signed, "doc_id bigint, text_hash bigint, n bigint, set_hash binary, sign binary"
    )
    signed = materialize(signed, "signatures")
    groups, named = _named_sets(signed)
    keyed = groups.select("id", "sign").mapInArrow(_keyed, "key bigint, id bigint")
    ends = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
    ends = materialize(ends.filter("n > 1"), "shared-keys")
    many = ends.filter("n > 2").select("key", "a")
    members = keyed.join(checked_broadcast(many, many.count(), BROADCAST_ROWS), "key")
    members = materialize(members, "members")
    stars = (
        ends.filter("n = 2").select("a", "b")
        .unionByName(members.filter("a < id").select("a", F.col("id").alias("b")))
        .distinct()
    )
    stars = materialize(stars, "stars")
    sign = groups.select("id", "sign")
    near = (
        stars.join(sign.select(F.col("id").alias("a"), F.col("sign").alias("sign_a")), "a")
        .join(sign.select(F.col("id").alias("b"), F.col("sign").alias("sign_b")), "b")
        .filter(_distance("sign_a", "sign_b") <= RADIUS)
        .select("a", "b")
    )
    involved = stars.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    involved = materialize(involved, "involved")
    wanted = checked_broadcast(involved, involved.count(), BROADCAST_ROWS)
    if named:
        texts = clean.withColumnRenamed("doc_id", "id").join(wanted, "id", "left_semi")
    else:
        chosen = groups.join(wanted, "id", "left_semi").select("id", F.col("first").alias("doc_id"), "text_hash")
        texts = clean.withColumn("text_hash", F.xxhash64("text")).join(chosen, ["doc_id", "text_hash"]).select("id", "text")
    sets = texts.mapInArrow(_full, "id bigint, n bigint, shingles binary, wide binary, least binary")
    sets = materialize(sets, "sets")
    links = _confirm(near, sets, "star-links")
    labels = components(links)
    more = _confirm(_residual(members.select("key", "id"), labels, sets), sets, "more-links")
    labels = components(links.unionByName(more))
    found = groups.join(labels, "id", "left").select("set_hash", "first", F.coalesce("label", "id").alias("component"))
    if not named:
        smallest = found.groupBy("component").agg(F.min("first").alias("smallest"))
        found = join_spread(found, smallest, ["component"], ["set_hash"]).drop("component").withColumnRenamed("smallest", "component")
    found = found.select("set_hash", "component")
    out = signed.select("doc_id", "text_hash", "n", "set_hash").join(found, "set_hash", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "text_hash",
    )


def _named_sets(signed: DataFrame) -> tuple[DataFrame, bool]:
    """Distinct sets (set_hash, id, first, text_hash, sign), and whether ``id`` is ``first``, the smallest doc_id, for all.

    ``text_hash`` is that of a text of ``first`` with the set. Where rows of one doc_id have unlike
    texts, several sets can have the same first one. Those after the first get names of their own, below all ids.
    """
    one = F.min(F.struct("doc_id", "text_hash")).alias("one")
    groups = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set_hash").agg(one, F.first("sign").alias("sign"))
    groups = groups.select("set_hash", F.col("one.doc_id").alias("first"), "one.text_hash", "sign")
    groups = materialize(groups, "distinct-sets")
    shared = groups.groupBy("first").agg(F.count("*").alias("n"), F.min("set_hash").alias("lowest")).filter("n > 1")
    shared = materialize(shared, "shared-ids")
    if shared.isEmpty():
        return groups.withColumn("id", F.col("first")), True
    below = groups.agg(F.min("first")).first()[0] - 1
    own = F.col("n").isNull() | (F.col("set_hash") == F.col("lowest"))
    name = F.when(own, F.col("first")).otherwise(F.lit(below) - F.monotonically_increasing_id())
    named = groups.join(shared, "first", "left").withColumn("id", name).drop("n", "lowest")
    return materialize(named, "named-sets"), False


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one document of each group: the one with the smallest id.

    Of rows that repeat an id and text, or a text without an id, any one stays. Rows that go or
    repeat are named by id and text hash and counted; they are broadcast if few, else the joins
    shuffle.
    """
    named = near_duplicates(docs).groupBy("doc_id", "text_hash").agg(
        F.bool_and("kept").alias("kept"), F.count("*").alias("n")
    )
    named = named.filter(~F.col("kept") | (F.col("n") > 1)).select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("text"), (~F.col("kept")).alias("gone")
    )
    named = materialize(named, "copies")
    text = F.col("text").cast("string")
    whole = F.sha2(text.cast("binary"), 256)
    return without_rows(docs, named, F.col("doc_id").cast("bigint"), F.xxhash64(text), whole, BROADCAST_ROWS)
