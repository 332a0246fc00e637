"""Fill-in-the-middle documents by rotating blocks inside one buffer per text.

A text is cut into prefix, middle and suffix at two places between its units. The sentinels go into a
bytearray of its bytes, and two neighbouring blocks change places by three reversals. To restore a
text the same blocks are rotated back and the sentinels taken out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"
_LATER = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point


def unit_ends(text: bytes) -> np.ndarray:
    """Where units end: a run of other characters with the white space before it, or white space at the end."""
    if not text:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(text, np.uint8)
    white = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    inside = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    return np.append(inside, len(text))


def _reverse(buffer: np.ndarray) -> None:
    half = len(buffer) // 2
    first = buffer[:half].copy()
    buffer[:half] = buffer[len(buffer) - half :][::-1]
    buffer[len(buffer) - half :] = first[::-1]


def rotate(buffer: bytearray, first: int, second: int, end: int) -> None:
    """Let the blocks ``first:second`` and ``second:end`` change places, by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    for a, b in ((first, second), (second, end), (first, end)):
        _reverse(view[a:b])


def arrange(text: bytes, first: int, last: int, form: str) -> bytes:
    """The text with ``first:last`` as its middle, in the order of ``form``."""
    if form == PLAIN:
        return text
    buffer = bytearray(text)
    for at, mark in ((last, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[at:at] = mark
    middle = len(PREFIX) + first
    suffix = middle + len(MIDDLE) + last - first
    rotate(buffer, middle if form == PSM else 0, suffix, len(buffer))
    return bytes(buffer)


def restored(output: bytes, form: str) -> bytes:
    """The text that ``arrange`` was given. No sentinel is in a text, so the first of each is the one."""
    if form == PLAIN:
        return output
    buffer = bytearray(output)
    if form == PSM:
        rotate(buffer, buffer.index(SUFFIX), buffer.index(MIDDLE), len(buffer))
    else:
        rotate(buffer, 0, buffer.index(PREFIX), len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def choose(doc_id: int | None, text: bytes, seed: int, percent: int, spm: int) -> tuple[int, str, int, int]:
    """Units of a text, its form, and the bytes after which prefix and middle end."""
    name = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    digest = hashlib.sha256(name).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    ends = unit_ends(text)
    n = len(ends)
    if not text or h3 % 100 >= percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, 0, 0
    first, last = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    return n, SPM if h4 % 100 < spm else PSM, first, last


def _chars(text: bytes) -> int:
    return len(text.translate(None, _LATER))


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm: int = 80) -> DataFrame:
    """Per row: doc_id, n (units), form, prefix_chars, middle_chars, output (the text rearranged).

    ``percent`` of the texts that can be rearranged are, ``spm`` percent of those with the suffix
    first. Both, and the cuts, depend on ``seed`` and doc_id alone. ``restore`` undoes it exactly. A null
    text is an empty one; an empty text, and one that holds a sentinel, stays plain, with null counts of
    characters. Rows that repeat an id have the same hashes, each with its own text; a null
    id is hashed as an empty one. An empty table gives no rows. Other columns are ignored.

    Rows are handled one by one where they are read: nothing is shuffled, and a task holds one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                n, form, first, last = choose(doc_id, text, seed, percent, spm)
                chars = (None, None) if form == PLAIN else (_chars(text[:first]), _chars(text[first:last]))
                rows.append((doc_id, n, form, *chars, arrange(text, first, last, form)))
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
                )

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(run, SCHEMA).withColumn("output", F.col("output").cast("string"))


def restore(made: DataFrame) -> DataFrame:
    """``made`` with the texts before ``transform`` as ``restored``, from ``output`` and ``form`` alone."""

    @F.arrow_udf("binary")
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        texts = zip(outputs.to_pylist(), forms.to_pylist())
        return pa.array([restored(output, form) for output, form in texts], pa.binary())

    text = back(F.col("output").cast("binary"), F.col("form")).cast("string")
    return small_batches(made).withColumn("restored", text)


def op11(docs: DataFrame) -> DataFrame:
    """Digests of the rearranged texts and of those restored from them; cases as in ``transform``."""
    return restore(transform(docs)).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
