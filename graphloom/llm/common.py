"""Helpers shared by the corpus operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.hot import fresh
from graphloom.scratch import materialize

__all__ = ["ascii_lower", "checked_broadcast", "fold", "fresh", "materialize", "small_batches", "table", "without_rows"]

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 500  # texts that go to a Python worker at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; pure ASCII takes the fast built-in."""
    plain = F.length(text) == F.octet_length(text)
    mapped = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(plain, F.lower(text)).otherwise(mapped)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id, so that it is in no fold."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % folds, F.lit(-1))


def checked_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast ``df`` if its counted ``rows`` are within ``limit``; else leave it to a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session set to hand at most ``BATCH_ROWS`` rows to Python at once.

    Texts can be long, and the default of 10,000 of them is too much for a small executor. The
    setting is the session's, as Spark reads it when the query runs.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH)) > BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def without_rows(docs: DataFrame, named: DataFrame, doc_id: Column, text_key: Column, whole: Column, limit: int) -> DataFrame:
    """``docs``, all columns, without the rows named as gone and with one row of each that repeats.

    ``named`` is a written table of distinct (id, text, gone): rows of that id and text key go if
    ``gone``, else any one of each id and ``whole``, which tells texts apart for certain, stays. It is
    counted and broadcast if within ``limit``. Only rows that repeat are shuffled, after a map-side part.
    ``docs`` may have columns of any names.
    """
    own_id, own_text = fresh("own_id", docs), fresh("own_text", docs)
    same = doc_id.eqNullSafe(F.col(own_id)) & text_key.eqNullSafe(F.col(own_text))
    names = named.select(F.col("id").alias(own_id), F.col("text").alias(own_text), "gone")
    left = docs.join(checked_broadcast(names.drop("gone"), named.count(), limit), same, "left_anti")
    again = names.filter(~F.col("gone")).drop("gone")
    if not (n := again.count()):
        return left
    once = docs.join(checked_broadcast(again, n, limit), same, "left_semi")
    once = once.withColumns({own_id: doc_id, own_text: whole}).dropDuplicates([own_id, own_text])
    return left.unionByName(once.drop(own_id, own_text))
