"""Bounded training samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold

SAMPLE = 20_000  # labelled documents that a classifier is fitted on at most


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, limit: int = SAMPLE
) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled documents outside the held-out fold.

    Which ones is settled by a hash of the id, so any run takes the same. A document labelled more
    than once has the larger label. The ids are ``limit`` rows at most, so they are broadcast.
    """
    doc_id: Column = F.col("doc_id").cast("bigint")
    chosen = (
        labels.select(doc_id.alias("_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("_id").isNotNull() & F.col("label").isNotNull())
        .filter(fold(F.col("_id"), folds) != held)
        .groupBy("_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(limit)
    )
    text = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id")
