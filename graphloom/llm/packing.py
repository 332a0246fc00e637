"""Packing of documents into token windows by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches
from graphloom.llm.tokens import encoder, together

WINDOW = 2048
END = 1
OPEN = 2048  # partially filled windows that a task holds at most
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)

Piece = tuple[object, int, bytes, int]  # doc_id, start, ids, doc_tokens


class SumOfSquares:
    """Online packing of pieces into windows, from one array of counts by fill level.

    ``count[h]`` is the number of open windows that hold h tokens. A piece goes where the sum of
    squares of the counts grows least: into a window of the level that gains most, or into a new
    one. Ties go to the fullest window. A window that is full leaves at once. With more than ``limit``
    windows open, the fullest one is filled with pieces cut from the emptiest and leaves too, so that
    memory is bounded; the rule goes on with the others. At the end all are filled that way, so at
    most one window of a task stays partly filled.
    """

    def __init__(self, window: int = WINDOW, limit: int = OPEN):
        self.window, self.limit = window, limit
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.n_open = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a piece shorter than a window; windows that are ready come back."""
        size = len(piece[2]) // 4
        levels = np.flatnonzero(self.count[1 : self.window - size + 1]) + 1
        level = 0
        if len(levels):
            # change of the sum of squares: 2 n(h + s) - 2 n(h) + 2, less 2 n(h + s) + 1 where full
            there = levels + size
            full = there == self.window
            change = 2 * np.where(full, 0, self.count[there]) - 2 * self.count[levels] + 2 - full
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= 2 * self.count[size] + 1:
                level = int(levels[best])
        pieces = self._taken(level) if level else []
        pieces.append(piece)
        if level + size == self.window:
            yield pieces
            return
        self._hold(level + size, pieces)
        if self.n_open > self.limit:
            yield self._fill_fullest()

    def finish(self) -> Iterator[list[Piece]]:
        while self.n_open:
            yield self._fill_fullest()

    def _hold(self, level: int, pieces: list[Piece]) -> None:
        self.open[level].append(pieces)
        self.count[level] += 1
        self.n_open += 1

    def _taken(self, level: int) -> list[Piece]:
        self.count[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _fill_fullest(self) -> list[Piece]:
        """The fullest window, with pieces of the emptiest ones cut to its size, or all that there are."""
        level = int(np.flatnonzero(self.count)[-1])
        pieces = self._taken(level)
        while level < self.window and self.n_open:
            have = int(np.flatnonzero(self.count)[0])
            donor = self._taken(have)
            while donor and level < self.window:
                doc_id, start, ids, total = donor.pop()
                take = min(len(ids) // 4, self.window - level)
                pieces.append((doc_id, start, ids[: 4 * take], total))
                level, have = level + take, have - take
                if 4 * take < len(ids):
                    donor.append((doc_id, start + take, ids[4 * take :], total))
            if donor:
                self._hold(have, donor)
        return pieces


def _rows(windows: Iterator[list[Piece]], first: int) -> Iterator[tuple]:
    for n, pieces in enumerate(windows):
        offset = 0
        for doc_id, start, ids, total in pieces:
            length = len(ids) // 4
            yield doc_id, start, length, ids, total, first + n, offset
            offset += length


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces of all documents, each with its ids (little-endian 32-bit) and its place in a window.

    Every id of a text and the closing ``end`` lie in exactly one piece. What is longer than a
    window is cut into whole windows and a rest; rests are placed by ``SumOfSquares``. Each scan
    task packs its own rows as they come, so nothing is shuffled, and at most one window of a task
    is not full. A null or empty text is one ``end``. Rows that repeat a document, also with a null
    id, are packed each on its own. An empty table gives no rows. Other columns are ignored.

    Window numbers hold the number of the task, so that a task that runs again gives the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        encode = encoder(tokenizer).encode
        closing = np.array([end], "<u4").tobytes()
        packer = SumOfSquares(window)

        def windows() -> Iterator[list[Piece]]:
            for doc_ids, texts in together(batches):
                for doc_id, ids in zip(doc_ids, encode(texts)):
                    ids += closing
                    total, whole = len(ids) // 4, len(ids) // (4 * window)
                    for k in range(whole):
                        yield [(doc_id, k * window, ids[4 * k * window : 4 * (k + 1) * window], total)]
                    if rest := ids[4 * whole * window :]:
                        yield from packer.add((doc_id, whole * window, rest, total))
            yield from packer.finish()

        yield from _batches(_rows(windows(), first))
        encoder(tokenizer).rest()

    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _batches(rows: Iterator[tuple], size: int = 2000) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    part: list[tuple] = []

    def made() -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(zip(*part), types)]
        return pa.RecordBatch.from_arrays(arrays, names)

    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield made()
            part = []
    if part:
        yield made()
