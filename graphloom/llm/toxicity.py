"""Toxicity by boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold, small_batches
from graphloom.llm.gbt import Isotonic, Trees, fit_isotonic, fit_trees
from graphloom.llm.supervised import SAMPLE, training_rows

FOLDS, HELD = 3, 1
THRESHOLD = 0.7
LEAST = 4  # toxic documents that a learned term occurs in at least
NEAR = 4  # words between an address and an insult that count as near

SEED = frozenset(
    "idiot idiots moron stupid dumb fool loser pathetic worthless disgusting scum trash clown ugly "
    "hate garbage filthy vermin retard bastard dummkopf dumm abschaum müll ekelhaft versager "
    "arschloch imbécile stupide crétin ordure salaud débile nul idiota estúpido imbécil basura "
    "asqueroso patético inútil".split()
)
YOU = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch ihr tu toi te ton ta vous votre tú ti "
    "usted ustedes vosotros vuestro".split()
)
_WORD = re.compile(r"[^\W_]+")
_LEET = str.maketrans("013457@$!", "oleastasi")
_MASK = re.compile(r"[0-9@$*!]")
# a run of word characters and marks with a letter behind its first mark; possessive, so linear
_MASKED = re.compile(r"(?<![\w@$*!])[^\W0-9]*+[0-9@$*!][\d_@$*!]*+[^\W\d_][\w@$*!]*+")
_SPELT = re.compile(r"(?:(?<=\s)|^)[^\W\d_](?:[-.*_ ][^\W\d_]){3,}(?=\s|$|[.,!?])")


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]
    trees: Trees
    calibrate: Isotonic

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.calibrate(self.trees.probability(features(texts, self.terms)))


def features(texts: list[str | None], terms: dict[str, float]) -> np.ndarray:
    """One row of dense numbers for each text; zeros for a null or empty one."""
    return np.array([_features(t or "", terms) for t in texts], float).reshape(len(texts), WIDTH)


def _features(text: str, terms: dict[str, float]) -> list[float]:
    words = _WORD.findall(text)
    low = [w.lower() for w in words]
    counts = Counter(low)
    n, chars = max(1, len(words)), max(1, len(text))
    hits = [k for k, w in enumerate(low) if w in terms or w in SEED]
    learned = [terms.get(low[k], 0.0) for k in hits]
    seed = sum(low[k] in SEED for k in hits)
    near = 0
    if hits:
        near = sum(not YOU.isdisjoint(low[max(0, k - NEAR) : k + NEAR + 1]) for k in hits)
    hidden = [m.translate(_LEET).lower() for m in _MASKED.findall(text)] if _MASK.search(text) else []
    spelt = [re.sub(r"[-.*_ ]", "", m).lower() for m in _SPELT.findall(text)]
    masked = sum(m in terms or m in SEED for m in hidden + spelt)
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return [
        seed,
        seed / n,
        len(hits),
        len(hits) / n,
        sum(learned),
        sum(learned) / n,
        max(learned, default=0.0),
        len({low[k] for k in hits}),
        near,
        near / n,
        sum(words[k].isupper() for k in hits),
        upper / chars,
        sum(len(w) > 1 and w.isupper() for w in words) / n,
        text.count("!") / chars,
        text.count("?") / chars,
        sum(map(text.count, ".,;:")) / chars,
        sum(map(text.count, "*#$%&@")) / chars,
        len(hidden) / n,
        len(spelt) / n,
        masked,
        masked / n,
        sum(map(counts.__getitem__, YOU)) / n,
        np.log1p(len(words)),
    ]


WIDTH = len(_features("", {}))


def lexicon(rows: DataFrame, least: int = LEAST) -> dict[str, float]:
    """Terms that stand in toxic texts far more often than in others, with their log odds.

    Counts are of documents, from (text, label). All terms in ``least`` toxic texts that pass come back;
    the sample of rows is bounded, and so are they.
    """
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)))
    counts = rows.select("label", word.alias("term")).groupBy("term").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")
    )
    total = rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    toxic, clean = total[0] or 0, total[1] or 0
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    found = (
        counts.filter(F.col("toxic") >= least)
        .withColumn("odds", odds)
        .filter(F.col("odds") > 2)
        .collect()
    )
    return {r["term"]: r["odds"] for r in found}


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold.

    The lexicon for the features of one half of the sample is learned on the other half, so that
    the trees do not trust terms more than new texts bear out. Trees are fitted on three quarters
    of the sample and calibrated on the last quarter. The sample is bounded, so it is collected.
    """
    rows = training_rows(small_batches(docs), labels, "toxic", folds, held, sample)
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)).cast("int")
    rows = rows.withColumn("part", part).persist()
    halves = [lexicon(rows.filter(F.col("part") % 2 == 1 - h), max(2, LEAST // 2)) for h in (0, 1)]
    whole = lexicon(rows)
    shape = rows.select("doc_id", "label", "part", _feature_column(lambda p: halves[p % 2])("text", "part").alias("x"))
    data = shape.orderBy("doc_id").toPandas()
    rows.unpersist()
    x = np.array(data["x"].tolist(), float).reshape(len(data), WIDTH)
    y = data["label"].to_numpy(float)
    late = data["part"].to_numpy() == 3
    trees = fit_trees(x[~late], y[~late])
    calibrate = fit_isotonic(trees.probability(x[late]), y[late]) if late.any() else fit_isotonic(y[:0], y[:0])
    return Model(whole, trees, calibrate)


def _feature_column(terms: Callable[[int], dict[str, float]]) -> Callable:
    @F.pandas_udf("array<double>")
    def run(text: pd.Series, part: pd.Series) -> pd.Series:
        return pd.Series([_features(t or "", terms(p)) for t, p in zip(text, part)])

    return run


def scorer(docs: DataFrame, model: Model) -> Column:
    """The score of each row of ``docs``; the model is bounded by SAMPLE and the trees."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(shared.value.score(part.tolist()), dtype=float)

    return run(F.col("text").cast("string"))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Every text is scored whole; a null or empty one as a text of no words. Columns of these names
    that ``docs`` already has are replaced, all others stay. Rows that repeat are scored each.
    """
    scored = docs.withColumn("score", scorer(docs, model))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows that score ``threshold`` or more."""
    return docs.filter(scorer(docs, model) < threshold)


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows by a model of the labelled ones that are not held out; cases as in ``score``."""
    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    scored = score(docs.select(doc_id, "text"), fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", "predicted")
