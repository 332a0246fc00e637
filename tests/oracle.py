"""Run a registered query and its SQL on the same tables and compare the results."""

import glob
import os

import duckdb
import pandas as pd
import pyarrow as pa


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sorted(table: pa.Table) -> tuple[dict[str, str], pd.DataFrame]:
    names = sorted(table.column_names)
    table = table.select(names)
    types = {n: str(t).replace("large_", "") for n, t in zip(names, table.schema.types)}
    return types, table.sort_by([(n, "ascending") for n in names]).to_pandas()


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None. Column order and row order do not count."""
    got_types, got = _sorted(spark_df.toArrow())
    want_types, want = _sorted(con.sql(sql).to_arrow_table())
    if got_types != want_types:
        return f"types {got_types} != {want_types}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    try:
        pd.testing.assert_frame_equal(got, want, check_exact=True)
    except AssertionError as error:
        return str(error)
    return None
