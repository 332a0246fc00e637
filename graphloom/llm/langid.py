"""Language identification: words first, shorter and shorter character runs for unseen words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold, fresh, small_batches

FOLDS, HELD = 4, 2
SAMPLE = 20_000  # documents that the model learns from at most, which also bounds its words and runs
LONGEST = 5  # characters of a run
LEAST = 2  # times that a word or run is seen at least
CACHE = 200_000  # unseen words that a worker keeps
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str) -> list[str]:
    """Runs of letters in lower case; other signs that Python takes for word characters are cut."""
    words = _WORD.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [p for w in words for p in "".join(c if c.isalpha() else " " for c in w).split()]


@dataclass(frozen=True)
class Model:
    """Log frequencies per language; row k of a table belongs to the entry with value k.

    It is sent as two long strings instead of an object per entry; no entry has a line break.
    """

    languages: list[str]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: dict[str, int]
    gram_rows: np.ndarray

    def __reduce__(self) -> tuple:
        return _model, (self.languages, "\n".join(self.words), self.word_rows, "\n".join(self.grams), self.gram_rows)

    def unseen(self, word: str) -> np.ndarray:
        """The mean of its longest known character runs, or nothing for any language."""
        marked = f"_{word}_"
        for size in range(LONGEST, 0, -1):
            rows = [self.grams[g] for k in range(len(marked) - size + 1) if (g := marked[k : k + size]) in self.grams]
            if rows:
                return self.gram_rows[rows].mean(axis=0)
        return np.zeros(len(self.languages))


def _model(languages: list[str], words: str, word_rows: np.ndarray, grams: str, gram_rows: np.ndarray) -> Model:
    tables = ({e: k for k, e in enumerate(x.split("\n") if x else [])} for x in (words, grams))
    return Model(languages, next(tables), word_rows, next(tables), gram_rows)


class Scorer:
    """Scores texts by a model, with a bounded cache of unseen words."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.row = dict(self.model.words)
        self.size = len(self.model.word_rows)
        self.whole = self.model.word_rows

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        count = len(self.model.languages)
        if self.size > len(self.model.word_rows) + CACHE:
            self._reset()
        found = [_words(t) if t else [] for t in texts]
        new = set()
        for words in found:
            new.update(filterfalse(self.row.__contains__, words))
        if new and count:
            rows = np.array([self.model.unseen(w) for w in new]).reshape(len(new), count)
            self.row.update(zip(new, range(self.size, self.size + len(new))))
            self.whole = np.concatenate([self.whole, rows])
            self.size += len(new)
        for words in found:
            if not words or not count:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            at = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
            total = self.whole[at].sum(axis=0)
            odds = np.exp(np.maximum(total - total.max(), -700))
            best = int(np.argmax(odds))
            names.append(self.model.languages[best])
            scores.append(float(odds[best] / odds.sum()))
        return names, scores


def _rows(counts: pa.Table, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Place and log frequencies of each entry, from (entry, [(lang, n)]), in the order of the entries."""
    names = pc.list_flatten(counts["seen"]).combine_chunks()
    row = pc.list_parent_indices(counts["seen"]).to_numpy()
    column = pc.index_in(names.field("lang"), pa.array(languages, pa.string())).to_numpy()
    order = pc.sort_indices(counts, [("entry", "ascending")]).to_numpy()
    place = np.empty_like(order)
    place[order] = np.arange(len(order), dtype=order.dtype)
    values = np.full((len(order), len(languages)), 0.1)
    values[place[row], column] += names.field("n").to_numpy()  # one for each entry and language
    values /= values.sum(axis=0, keepdims=True)
    entries = counts["entry"].take(pa.array(order)).to_pylist()
    return {e: k for k, e in enumerate(entries)}, np.log(values, out=values)


def _seen(counts: DataFrame, key: str) -> pa.Table:
    """(entry, [(lang, n)]) of all entries seen ``LEAST`` times or more. They are those of a bounded sample, so
    collected: one row for each, as Arrow holds them, as rows of Python and a pivot are many times as large."""
    entries = counts.groupBy(F.col(key).alias("entry")).agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("seen")
    )
    return entries.filter(F.col("total") >= LEAST).select("entry", "seen").toArrow()


def _languages(counts: pa.Table) -> set[str]:
    return set(pc.list_flatten(counts["seen"]).combine_chunks().field("lang").unique().to_pylist())


def fit(docs: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` documents with a language outside the held-out fold, chosen by
    a hash of the id. Counts are made on the executors. All words and character runs that the sample
    holds ``LEAST`` times are in the model, of whatever language, so it grows with the sample alone."""
    doc_id = F.col("doc_id").cast("bigint")
    known = docs.select(doc_id.alias("_id"), F.col("lang").cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("_id").isNotNull() & (fold(F.col("_id"), folds) != held)
    )
    chosen = known.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(doc_id.alias("_id"), "lang", F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull()).join(F.broadcast(chosen), "_id")
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))
    words = rows.select("lang", word.alias("word")).groupBy("word", "lang").agg(F.count("*").alias("n"))
    words = words.persist()
    marked = F.concat(F.lit("_"), F.col("word"), F.lit("_"))
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(LONGEST)),
            lambda size: F.transform(
                F.filter(F.sequence(F.lit(1), F.length(marked)), lambda at: at + size - 1 <= F.length(marked)),
                lambda at: F.substring(marked, at, size),
            ),
        )
    )
    grams = words.select("lang", "n", F.explode(runs).alias("gram")).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    word_counts = _seen(words, "word")
    gram_counts = _seen(grams, "gram")
    words.unpersist()
    languages = sorted(_languages(word_counts) | _languages(gram_counts))
    if not languages:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    return Model(languages, *_rows(word_counts, languages), *_rows(gram_counts, languages))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, the share of the best language).

    Whole texts are read. A null text or one without letters is ``und`` with score 0, and so is
    everything where nothing was learned. Ties go to the first language by name. Columns of these
    names that ``docs`` already has are replaced, all others stay.
    """
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for part in texts:
            names, scores = scorer(part.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    name = fresh("found", docs)
    found = docs.withColumn(name, run(F.col("text").cast("string")))
    found = found.withColumn("lang_pred", F.col(name)["lang_pred"]).withColumn("score", F.col(name)["score"])
    return found.drop(name)


def op9(docs: DataFrame) -> DataFrame:
    """Predictions for all rows by a model of those that are not held out; cases as in ``identify``."""
    found = identify(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), fit(docs))
    held_out = (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")
