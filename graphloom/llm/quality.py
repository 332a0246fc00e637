"""Text quality by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold, small_batches
from graphloom.llm.gbt import Trees, fit_trees
from graphloom.llm.supervised import SAMPLE, training_rows

FOLDS, HELD = 4, 2
THRESHOLD = 0.7
_MARKS = "!?.,;:'\"-|*#$%&@/\\<>{}[]()=+_~^"
_UPPER, _LOWER, _DIGIT, _BLANK, _FEED, _HIGH, _CONTROL = range(7)


def _byte_classes() -> np.ndarray:
    classes = np.full(256, _CONTROL)
    classes[ord("A") : ord("Z") + 1] = _UPPER
    classes[ord("a") : ord("z") + 1] = _LOWER
    classes[ord("0") : ord("9") + 1] = _DIGIT
    classes[32], classes[9], classes[10], classes[128:] = _BLANK, _BLANK, _FEED, _HIGH
    for k, c in enumerate(_MARKS):
        classes[ord(c)] = _CONTROL + 1 + k
    return classes


_CLASSES = _byte_classes()


def statistics(text: str) -> list[float]:
    """Numbers that describe how a text is written, not what it says; all finite for any text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    counts = np.bincount(_CLASSES[raw], minlength=_CONTROL + 1 + len(_MARKS)) / n
    words = text.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen = Counter(words)
    again = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lines = text.split("\n")
    common = seen.most_common(1)[0][1] if seen else 0
    plain = sum(c for w, c in seen.items() if w.isalpha())
    shout = sum(c for w, c in seen.items() if w.isupper() and len(w) > 1)
    alone = sum(c for w, c in seen.items() if len(w) == 1 and not w.isalnum())
    long = sum(c for w, c in seen.items() if len(w) > 20)
    ends = sum(line.rstrip()[-1:] in (".", "!", "?", '"', ":") for line in lines)
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        len(seen) / k,
        len(seen) / np.sqrt(k),
        common / k,
        again / k,
        pairs / k,
        plain / k,
        shout / k,
        alone / k,
        long / k,
        len(set(lines)) / len(lines),
        len(words) / len(lines),
        ends / len(lines),
        counts[_UPPER] / max(1e-9, counts[_UPPER] + counts[_LOWER]),
        *counts,
    ]


WIDTH = len(statistics(""))


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], float).reshape(len(texts), WIDTH)


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled documents outside the held-out fold; their statistics
    are computed on the executors and collected, as the sample is bounded."""
    rows = training_rows(small_batches(docs), labels, "quality", folds, held, sample)

    @F.pandas_udf("array<double>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([statistics(t or "") for t in text])

    data = rows.select("doc_id", "label", run("text").alias("x")).orderBy("doc_id").toPandas()
    x = np.array(data["x"].tolist(), float).reshape(len(data), WIDTH)
    return fit_trees(x, data["label"].to_numpy(float))


def score(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, high for label 1) and ``predicted`` (1 from ``threshold`` on).

    Every text is scored whole; a null or empty one by the statistics of an empty text. Columns of
    these names that ``docs`` already has are replaced, all others stay.
    """
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)  # a few thousand nodes

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(shared.value.probability(matrix(part.tolist())), dtype=float)

    scored = docs.withColumn("score", run(F.col("text").cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows by a model of the labelled ones that are not held out; cases as in ``score``."""
    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    scored = score(docs.select(doc_id, "text"), fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", "predicted")
