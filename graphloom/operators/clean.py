"""Which interactions are kept, and how many are dropped for which reason."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


DAY = 86_400_000_000  # microseconds


def _null_key() -> Column:
    return F.col("u").isNull() | F.col("i").isNull()


def _bad_rating() -> Column:
    return F.coalesce(~F.col("r").between(1, 5), F.lit(False))


def accepted(interactions: DataFrame) -> DataFrame:
    """Rows with both keys and, if graded, a grade 1-5. Duplicates are still in."""
    return interactions.where(~_null_key() & ~_bad_rating())


def dedupe_latest(interactions: DataFrame) -> DataFrame:
    """One row per (dataset, u, i): the latest, then the best graded, nulls last.

    Time and grade are packed into one number to order by, whose maximum a hash aggregation finds without a
    sort, before the shuffle too, so a pair repeated without end costs little.
    """
    day, part = F.unix_date(F.col("ts").cast("date")).cast("bigint"), F.lit(2**33).cast("decimal(11,0)")
    second = F.hour("ts") * 3600 + F.minute("ts") * 60
    micros = day * DAY + second.cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), "ts") * 1_000_000).cast("bigint")
    # a null lies below every time and every grade; grades are 32-bit, so 2^33 holds them apart
    time = F.coalesce(micros, F.lit(-(2**63))).cast("decimal(20,0)")
    grade = F.coalesce(F.col("r").cast("bigint"), F.lit(-(2**31) - 1)) + (2**31 + 1)
    packed = (time * part + grade.cast("decimal(11,0)")).cast("decimal(38,0)")
    # the latest time is that of the row that is kept
    return interactions.groupBy("dataset", "u", "i").agg(F.max_by("r", packed).alias("r"), F.max("ts").alias("ts"))


def reject_report(interactions: DataFrame, dataset: str, bad_rows: DataFrame | None = None) -> DataFrame:
    """Rows set aside per dataset and reason; each row counts once, under the first that fits.

    Order: ``bad_row`` (kept apart by the CSV reader, which knows no dataset, so they count for
    ``dataset``), ``null_key``, ``bad_rating``, and ``superseded``: rows that a later one of the same user
    and item replaces wherever grades count. Those are still events, and are counted as such.
    """
    null_key, bad_rating = _null_key(), _bad_rating()
    per_pair = interactions.groupBy("dataset", "u", "i").agg(
        F.count_if(null_key).alias("null_key"),
        F.count_if(~null_key & bad_rating).alias("bad_rating"),
        F.count_if(~null_key & ~bad_rating).alias("kept"),
    )
    reasons = ["null_key", "bad_rating", "superseded"]
    report = (
        per_pair.groupBy("dataset")
        .agg(
            F.sum("null_key").alias("null_key"),
            F.sum("bad_rating").alias("bad_rating"),
            F.sum(F.greatest(F.col("kept") - 1, F.lit(0))).alias("superseded"),
        )
        .unpivot(["dataset"], reasons, "reason", "n")
    )
    spark = interactions.sparkSession
    zero = spark.range(1).select(
        F.lit(dataset).alias("dataset"), F.explode(F.array(*map(F.lit, reasons))).alias("reason"), F.lit(0).cast("bigint").alias("n")
    )
    report = report.unionByName(zero)
    if bad_rows is not None:
        bad = bad_rows.agg(F.count("*").alias("n"))
        report = report.unionByName(bad.select(F.lit(dataset).alias("dataset"), F.lit("bad_row").alias("reason"), "n"))
    return report.groupBy("dataset", "reason").agg(F.sum("n").alias("n"))
