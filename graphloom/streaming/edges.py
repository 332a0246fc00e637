"""User-item edges from a stream of events.

Events come as files that appear in a folder. ``follow_edges`` keeps one state per user and item and never
drops an event, however late; ``follow_daily_edges`` keeps the edges of open days only, and closes a day
when the watermark has passed it. Both end when all files are read, and go on where they
stopped when called again with the same ``state`` folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "dataset string, u bigint, i bigint, r int, ts timestamp_ntz"
EDGE = ["dataset", "u", "i"]
EDGES = "dataset string, u bigint, i bigint, w bigint, first_ts timestamp_ntz, last_ts timestamp_ntz"
DAILY = "dataset string, day date, u bigint, i bigint, w bigint"


def event_files(spark: SparkSession, folder: str, files_at_once: int = 1, schema: str = EVENTS) -> DataFrame:
    """A stream of the Parquet files of a folder, ``files_at_once`` in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def _finished(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    return query


def follow_edges(events: DataFrame, out: str, state: str) -> StreamingQuery:
    """Write, per batch, the edges that it changed, with all that is known of them since the start.

    Each batch has its own folder, which a repeated batch writes again, so a failure between two
    batches neither loses nor doubles an event. The state is one row per edge, partitioned by it.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    edges = events.groupBy(*EDGE).agg(
        F.count("*").alias("w"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    writer = edges.writeStream.outputMode("update").foreachBatch(write)
    return _finished(writer.option("checkpointLocation", state).trigger(availableNow=True).start())


def edges_now(spark: SparkSession, out: str) -> DataFrame:
    """The edges as the last batch that changed each of them left them.

    The events of an edge only get more and its times only wider, so that is the largest and the smallest of each value.
    """
    batches = spark.read.schema(f"{EDGES}, batch bigint").parquet(out)
    return batches.groupBy(*EDGE).agg(
        F.max("w").alias("w"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )


def follow_daily_edges(events: DataFrame, out: str, state: str, delay: str = "1 day") -> StreamingQuery:
    """Append the edges of each calendar day once the watermark, ``delay`` behind the last event, has passed its end.

    State is held for open days only. An event of a day that is closed already comes too late: it changes
    nothing, and ``late_rows`` of the query counts it. The watermark moves between batches.
    """
    known = events.where(F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
    daily = (
        known.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("day"), *EDGE)
        .agg(F.count("*").alias("w"))
        .select("dataset", F.col("day.start").cast("date").alias("day"), "u", "i", "w")
    )
    writer = daily.writeStream.format("parquet").outputMode("append").option("path", out)
    return _finished(writer.option("checkpointLocation", state).trigger(availableNow=True).start())


def late_rows(query: StreamingQuery) -> int:
    """Partial sums of events that came after their day was closed, over the batches of a query."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
