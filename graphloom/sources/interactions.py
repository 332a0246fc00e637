"""Adapters to the canonical table ``dataset, u, i, r, ts``."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import rating_from_quantity
from graphloom.sources.csv import CsvTable, read_csv

ORDERS = """
    o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
    o_orderdate timestamp_ntz, o_orderpriority string
"""
LINEITEM = """
    l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
    l_quantity double, l_extendedprice double, l_discount double, l_tax double,
    l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz
"""
EVENTS = """
    event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
    value double, props string
"""


def canonical(
    df: DataFrame, dataset: str, u: Column, i: Column, r: Column, ts: Column, key: str = "bigint"
) -> DataFrame:
    """Any table with a user, an item, a grade and a time, as interactions.

    Where the keys are text, give ``key="string"``; ``build_graph`` numbers them.
    """
    return df.select(
        F.lit(dataset).alias("dataset"),
        u.cast(key).alias("u"),
        i.cast(key).alias("i"),
        r.cast("int").alias("r"),
        ts.cast("timestamp_ntz").alias("ts"),
    )


def from_columns(df: DataFrame, dataset: str, columns: dict[str, str], key: str = "string") -> DataFrame:
    """Any table as interactions, by the names of its columns: ``u`` and ``i``, and ``r`` and ``ts`` if it
    has them. Keys of any type are numbered by the job."""
    r, ts = (F.col(columns[c]) if c in columns else F.lit(None) for c in ("r", "ts"))
    return canonical(df, dataset, F.col(columns["u"]), F.col(columns["i"]), r, ts, key)


def from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Source A: a line item is a purchase of its part by the customer of its order."""
    joined = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
    return canonical(
        joined,
        "a",
        F.col("o_custkey"),
        F.col("l_partkey"),
        rating_from_quantity(F.col("l_quantity")),
        F.col("o_orderdate"),
    )


def from_events(events: DataFrame) -> DataFrame:
    """Source B: an event is a visit of ``props.k``; it has no grade."""
    return canonical(
        events,
        "b",
        F.col("user_id"),
        F.get_json_object("props", "$.k").try_cast("bigint"),
        F.lit(None),
        F.col("ts"),
    )


def interactions_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_orders(
        spark.read.parquet(f"{sf_dir}/orders.parquet"),
        spark.read.parquet(f"{sf_dir}/lineitem.parquet"),
    )


def interactions_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def interactions_a_csv(spark: SparkSession, csv_dir: str) -> CsvTable:
    orders = read_csv(spark, f"{csv_dir}/orders", ORDERS, multiline=False)
    lineitem = read_csv(spark, f"{csv_dir}/lineitem", LINEITEM, multiline=False)
    return CsvTable(
        rows=from_orders(orders.rows, lineitem.rows),
        bad=orders.bad.unionByName(lineitem.bad),
    )


def interactions_b_csv(spark: SparkSession, csv_dir: str) -> CsvTable:
    events = read_csv(spark, f"{csv_dir}/events", EVENTS, multiline=False)
    return CsvTable(rows=from_events(events.rows), bad=events.bad)
