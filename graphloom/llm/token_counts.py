"""Token counts of whole texts by byte-pair merging, without making ids.

A word is a linked list of symbols, and a heap holds the pairs of neighbours that the vocabulary
can merge. The pair of the lowest rank is merged until none is left, so the tokens of a word are its
symbols less the merges. A symbol outside the vocabulary counts as its bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches

LIMIT = 4096
SPACE = "▁"
CACHE = 300_000  # words, and parts of words, whose count a Python worker keeps
LONGEST = 64  # characters of a word that is kept
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_loaded: dict[str, Counts] = {}


class Merges:
    """Pieces of a vocabulary by rank: the better the score, the lower the rank."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor):
        size = model.get_piece_size()
        special = [model.is_control(k) or model.is_unknown(k) or model.is_byte(k) for k in range(size)]
        if any(model.is_unused(k) for k in range(size)):
            raise ValueError("a vocabulary with unused pieces is not merged by rank alone")
        self.rank = {model.id_to_piece(k): -model.get_score(k) for k in range(size) if not special[k]}
        if not any(model.is_byte(k) for k in range(size)):
            raise ValueError("a vocabulary without bytes counts neighbouring unknown symbols as one")
        self.pairs = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}

    def parts(self, word: str) -> list[str]:
        """The word cut where no piece has the two characters beside each other, so none can be merged."""
        pairs, first, found = self.pairs, 0, []
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in pairs:
                found.append(word[first:k])
                first = k
        found.append(word[first:])
        return found

    def count(self, word: str) -> int:
        """Tokens of a word: symbols, less merges, plus the further bytes of unknown symbols."""
        rank = self.rank
        n = len(word)
        heap = [(rank[pair], k, 2) for k in range(n - 1) if (pair := word[k : k + 2]) in rank]
        symbols: list[str] = list(word)
        merges = 0
        if heap:
            heapq.heapify(heap)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            pop, push = heapq.heappop, heapq.heappush
            while heap:
                _, left, length = pop(heap)
                right = after[left]
                first = symbols[left]
                if not first or right >= n or len(first) + len(symbols[right]) != length:
                    continue  # one of the two has been merged with another since
                symbols[left] = first = first + symbols[right]
                symbols[right] = ""
                merges += 1
                after[left] = last = after[right]
                if last < n:
                    before[last] = left
                    if (merged := first + symbols[last]) in rank:
                        push(heap, (rank[merged], left, len(merged)))
                if left and (merged := symbols[back := before[left]] + first) in rank:
                    push(heap, (rank[merged], back, len(merged)))
        if word.isascii():
            return n - merges
        return n - merges + sum(len(c.encode()) - 1 for c in symbols if c and c not in rank)


class _Parts(dict):
    """Tokens of the parts of words. Full, it starts anew; frequent ones are soon back."""

    def __init__(self, merges: Merges):
        self.count = merges.count

    def __missing__(self, part: str) -> int:
        n = self.count(part)
        if len(part) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[part] = n
        return n


class _Words(dict):
    """Tokens by word, ``space`` before it, as the sum over its parts."""

    def __init__(self, merges: Merges, parts: _Parts, space: str):
        self.cut, self.part, self.space = merges.parts, parts.__getitem__, space

    def __missing__(self, word: str) -> int:
        n = sum(map(self.part, self.cut(self.space + word)))
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n


class Counts:
    """Same numbers as ``len(SentencePieceProcessor(model_file=path).encode(text))``.

    No piece holds white space behind another character, so no merge crosses the place before white
    space: runs from there on are merged on their own, and kept as words repeat. The same
    holds on both sides of a line break, if no piece has one.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.merges = Merges(self.model)
        pieces = self.merges.rank
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.lines = not any("\n" in p for p in pieces)
        parts = _Parts(self.merges)
        self.spaced, self.bare = _Words(self.merges, parts, SPACE), _Words(self.merges, parts, "")

    def count(self, text: str) -> int:
        """Tokens of a text, normalised as the model asks for."""
        text = self.model.normalize(text)
        if not self.cuts:
            return self.merges.count(text)
        if not self.lines:
            return self._line(text)
        lines = text.split("\n")
        return sum(map(self._line, lines)) + len(lines) - 1

    def _line(self, line: str) -> int:
        if not line:
            return 0
        if SPACE * 2 in line:
            return sum(map(self.bare.__getitem__, _RUNS.findall(line)))
        first, *words = line.split(SPACE)
        return sum(map(self.spaced.__getitem__, words)) + (self.bare[first] if first else 0)


def counter(path: str) -> Counts:
    """One per Python worker, kept from task to task."""
    if path not in _loaded:
        _loaded[path] = Counts(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than ``limit``).

    Begin and end marks are not counted; their strings in a text are ordinary text. A null text is an
    empty one, and an empty text has no tokens. Rows that repeat an id, or have none, are counted each
    on its own. An empty table gives no rows. Other columns are ignored. Bytes that are no UTF-8 are read as
    U+FFFD.

    Rows are counted where they are read: nothing is shuffled. A worker holds one batch, ``CACHE``
    words and parts of words of at most ``LONGEST`` characters, and the symbols of one word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for batch in batches:
            texts = batch["text"].to_pylist()
            n_bytes = pa.array(map(len, texts), pa.int64())
            n_tokens = pa.array([count(t.decode("utf-8", "replace")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], n_bytes, n_tokens], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    counted = rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
