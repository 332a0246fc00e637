"""Session for tests and benchmarks. On a cluster the caller brings a session."""

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "graphloom", shared: str | None = None) -> SparkSession:
    """``shared`` is the folder for tables between stages; a new one below /tmp if not given."""
    shared = shared or tempfile.mkdtemp(prefix="graphloom-")  # one machine, so its folders are shared
    partitions = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # small groups make many pairs: keep all cores busy although their input is small
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
