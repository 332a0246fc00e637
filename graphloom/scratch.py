"""Tables written between stages, to cut lineage so that lost executors cost little."""

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
ROW_BITS = 33  # fixed by Spark: monotonically_increasing_id keeps the row number in the low 33 bits
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())  # paths, by the open steps


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (master ``local``) gets a temporary folder, which its
    threads share; any other must name one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="graphloom-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below one folder per application, which can go when the application ends."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/graphloom-{app}/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """What is run inside is planned with this setting of the session; then it is as before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """What is run inside leaves no shuffle files: they go when its query has ended, instead of when the
    driver happens to collect its garbage. For writes, whose rows are read from what was written."""
    return setting(spark, _CLEANUP, "true")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and return a scan of what was written.

    Results are lazy and read such tables, so they stay until the application has ended; then its
    one folder can be removed as a whole. Those that only a step itself reads go before, see ``step``.
    """
    path = scratch_path(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    if written := _written.get():
        written[-1].append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove tables that ``materialize`` wrote, by their ``scratch``, when nothing will read them any more."""
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def step(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` returns, written; then the other tables that were written meanwhile are removed."""
    token = _written.set((*_written.get(), []))
    try:
        made = make()
        inner = _written.get()[-1]
    finally:
        _written.reset(token)
    made = materialize(made, label)
    discard(spark, *inner)
    return made
