"""Token ids on disk as wavelet matrices: one compressed file per shard of documents.

A shard file holds the ids of its documents as bit planes, highest bit first. Below each plane the
ids are parted stably by that bit, so counts of set bits (rank) and their places (select) are enough
to get at any token, to count one, and to list where it occurs. Files are values of a Parquet
table, which is how Spark writes them to any store.

File: magic, length of the head, head as JSON (counts, zeros per plane, places of the sections),
then the sections, each compressed on its own: ids and lengths of the documents, and for every plane
its bits and its directory, the number of set bits before each block of 512.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches
from graphloom.llm.tokens import encoder, together
from graphloom.scratch import scratch_path

MAGIC = b"GLWM0001"
END = 2
BLOCK = 512  # bits between two entries of a directory
PART = 1 << 17  # tokens that are moved at once, so that they and their places stay near the core; whole bytes of bits
TOKENS = 4_000_000  # tokens of a shard, unless one document has more
SHARDS = "part bigint, seq bigint, n_docs bigint, n_tokens bigint, file binary"


def write_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, level: int = 1) -> bytes:
    """The file of documents with the given ids and numbers of tokens, one after the other."""
    pack = zstandard.ZstdCompressor(level=level).compress
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    small = np.uint16 if width <= 16 else np.uint32
    now, zeros, sections = ids.astype(small), [], []
    known = np.array([d is not None for d in doc_ids], bool)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    sections.append(pack(np.packbits(known).tobytes() + numbers.tobytes()))
    sections.append(pack(np.asarray(lengths, "<i8").tobytes()))
    spare = np.empty_like(now)
    full = np.zeros(-(-len(now) // BLOCK) * BLOCK // 8, np.uint8)  # the bits, up to a whole block
    for plane in range(width - 1, -1, -1):
        ones = (now & small(1 << plane)).astype(bool)
        bits = np.packbits(ones)
        full[: len(bits)] = bits
        sections.append(pack(bits))
        blocks = np.bitwise_count(full.view(np.uint64).reshape(-1, BLOCK // 64)).sum(axis=1, dtype=np.uint32)
        sections.append(pack(np.concatenate([[0], np.cumsum(blocks)]).astype("<u4").tobytes()))
        zeros.append(len(ones) - int(blocks.sum()))
        low, high = 0, zeros[-1]
        for at in range(0, len(now), PART):
            some, up = now[at : at + PART], ones[at : at + PART]
            places = np.flatnonzero(up)
            some.take(places, out=spare[high : high + len(places)], mode="clip")
            high += len(places)
            places = np.flatnonzero(~up)
            some.take(places, out=spare[low : low + len(places)], mode="clip")
            low += len(places)
        now, spare = spare, now
    head = json.dumps(
        {"docs": len(doc_ids), "tokens": len(ids), "planes": width, "zeros": zeros, "sizes": [len(s) for s in sections]}
    ).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections])


class Shard:
    """Reads a shard file; a section is decompressed when it is first asked for."""

    def __init__(self, file: bytes):
        if file[:8] != MAGIC:
            raise ValueError("no shard file")
        (size,) = struct.unpack("<I", file[8:12])
        head = json.loads(file[12 : 12 + size])
        self.n_docs, self.n_tokens, self.planes = head["docs"], head["tokens"], head["planes"]
        self.zeros: list[int] = head["zeros"]
        self._file = file
        self._ends = 12 + size + np.concatenate([[0], np.cumsum(head["sizes"])])
        self._open: dict[int, bytes] = {}

    def _section(self, k: int) -> bytes:
        if k not in self._open:
            raw = self._file[int(self._ends[k]) : int(self._ends[k + 1])]
            self._open[k] = zstandard.ZstdDecompressor().decompress(raw)
        return self._open[k]

    @cached_property
    def doc_ids(self) -> list[int | None]:
        raw, size = self._section(0), -(-self.n_docs // 8)
        known = np.unpackbits(np.frombuffer(raw[:size], np.uint8))[: self.n_docs]
        return [int(d) if k else None for d, k in zip(np.frombuffer(raw[size:], "<i8"), known)]

    @cached_property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.frombuffer(self._section(1), "<i8"))])

    def _bits(self, level: int) -> bytes:
        return self._section(2 + 2 * level)

    def _directory(self, level: int) -> np.ndarray:
        return np.frombuffer(self._section(3 + 2 * level), "<u4")

    def _bit(self, level: int, at: int) -> int:
        return self._bits(level)[at >> 3] >> (7 - (at & 7)) & 1

    def _ones(self, level: int, at: int) -> int:
        """Set bits before place ``at``."""
        block = at // BLOCK
        first, last = block * BLOCK // 8, at >> 3
        bits = self._bits(level)
        found = int(self._directory(level)[block]) + int.from_bytes(bits[first:last], "big").bit_count()
        return found + ((bits[last] >> (8 - (at & 7))).bit_count() if at & 7 else 0)

    def _place(self, level: int, bit: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) bit with the value ``bit``."""
        directory = self._directory(level).astype(np.int64)
        if not bit:
            directory = np.minimum(np.arange(len(directory)) * BLOCK, self.n_tokens) - directory
        block = int(np.searchsorted(directory, nth, side="right")) - 1
        part = np.frombuffer(self._bits(level), np.uint8, min(BLOCK // 8, -(-self.n_tokens // 8) - block * BLOCK // 8), block * BLOCK // 8)
        inside = np.flatnonzero(np.unpackbits(part)[: self.n_tokens - block * BLOCK] == bit)
        return block * BLOCK + int(inside[nth - directory[block]])

    def access(self, at: int) -> int:
        """The token at a place."""
        value = 0
        for level in range(self.planes):
            bit = self._bit(level, at)
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, first: int, last: int) -> tuple[int, int]:
        for level in range(self.planes):
            a, b = self._ones(level, first), self._ones(level, last)
            if token >> (self.planes - 1 - level) & 1:
                first, last = self.zeros[level] + a, self.zeros[level] + b
            else:
                first, last = first - a, last - b
        return first, last

    def rank(self, token: int, end: int) -> int:
        """How often a token occurs before a place."""
        if token >> self.planes:
            return 0
        first, last = self._range(token, 0, end)
        return last - first

    def count(self, token: int) -> int:
        return self.rank(token, self.n_tokens)

    def select(self, token: int, nth: int) -> int:
        """The place of the ``nth`` (from 0) occurrence of a token."""
        if not 0 <= nth < self.count(token):
            raise IndexError(nth)
        at = self._range(token, 0, self.n_tokens)[0] + nth
        for level in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - level) & 1
            at = self._place(level, bit, at - self.zeros[level] if bit else at)
        return at

    def places(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All tokens, plane by plane from the lowest."""
        small = np.uint16 if self.planes <= 16 else np.uint32
        values = np.zeros(self.n_tokens, small)
        above = np.empty_like(values)
        for level in range(self.planes - 1, -1, -1):
            bits = np.frombuffer(self._bits(level), np.uint8)
            low, high = 0, self.zeros[level]
            values[high:] |= small(1 << (self.planes - 1 - level))
            for at in range(0, self.n_tokens, PART):
                up = np.unpackbits(bits[at // 8 : (at + PART) // 8])[: self.n_tokens - at].astype(bool)
                some = above[at : at + PART]
                places = np.flatnonzero(up)
                some[places] = values[high : high + len(places)]
                high += len(places)
                places = np.flatnonzero(~up)
                some[places] = values[low : low + len(places)]
                low += len(places)
            values, above = above, values
        return values.astype("<u4")


def _shards(batches: Iterator[pa.RecordBatch], tokenizer: str, end: int, limit: int) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    encode, closing = encoder(tokenizer).encode, np.array([end], "<u4").tobytes()
    ids: list[int | None] = []
    held: list[bytes] = []
    size = 0

    def made() -> pa.RecordBatch:
        lengths = np.array([len(x) // 4 for x in held], np.int64)
        file = write_shard(ids, lengths, np.frombuffer(b"".join(held), "<u4"))
        columns = [[part], [seq], [len(ids)], [size]]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns), pa.array([file], pa.binary())],
            ["part", "seq", "n_docs", "n_tokens", "file"],
        )

    for doc_ids, texts in together(batches):
        for doc_id, raw in zip(doc_ids, encode(texts)):
            if ids and size + len(raw) // 4 + 1 > limit:
                yield made()
                ids, held, size, seq = [], [], 0, seq + 1
            ids.append(doc_id)
            held.append(raw + closing)
            size += len(raw) // 4 + 1
    if ids:
        yield made()
    encoder(tokenizer).rest()


def write(docs: DataFrame, tokenizer: str, path: str, end: int = END, limit: int = TOKENS) -> None:
    """Shards of all documents in ascending order of doc_id at ``path``.

    A null or empty text is one ``end``. Rows that repeat an id are documents of their own, in the
    order of their texts; rows without an id come first. An empty table gives no shard. Documents
    are dealt by ranges of ids; a task holds the tokens of one shard at a time.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(lambda batches: _shards(batches, tokenizer, end, limit), SHARDS)
    shards.write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
    for batch in batches:
        for k in range(batch.num_rows):
            shard = Shard(batch["file"][k].as_py())
            tokens, starts = shard.tokens(), shard.starts
            sums = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])]
            n = shard.n_docs
            columns = [[batch["part"][k].as_py()] * n, [batch["seq"][k].as_py()] * n, shard.doc_ids, starts[:-1], np.diff(starts), sums]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from its shard file: doc_id, start, n_tokens, ids_crc32."""
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # one row per task of the writer, so one task is enough here
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("within"))
    bases = bases.join(parts, "part").select("part", "seq", (F.col("base") + F.col("within")).alias("base"))
    found = shards.select("part", "seq", "file").mapInArrow(
        _documents, "part bigint, seq bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return found.join(bases, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def op7(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Shards of all documents written, and the documents as read back from them; cases as in ``write``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    write(docs, tokenizer, path)
    return read_documents(spark.read.schema(SHARDS).parquet(path))
