import random
from datetime import date, datetime, timedelta

import pytest

from graphloom.operators.bipartite import bipartite_edges
from graphloom.streaming.edges import edges_now, event_files, follow_daily_edges, follow_edges, late_rows
from tests.conftest import visits


def put(spark, folder, batches):
    """Each batch as one file, the earlier ones with the earlier time, as a source takes them by age."""
    import os
    import time
    from pathlib import Path

    for n, rows in enumerate(batches):
        made = folder / f"made-{n}-{len(list(folder.glob('*')))}"
        df = spark.createDataFrame(rows, "u bigint, i bigint, r int, ts timestamp_ntz").selectExpr("'t' AS dataset", "*")
        df.coalesce(1).write.parquet(str(made))
        (file,) = Path(made).glob("*.parquet")
        (folder / "in").mkdir(exist_ok=True)
        target = folder / "in" / f"{made.name}.parquet"
        target.write_bytes(file.read_bytes())
        os.utime(target, (time.time() - 10_000 + 10 * n,) * 2)


def split(rows, seed, parts):
    rng = random.Random(seed)
    out = [[] for _ in range(parts)]
    for row in rows:
        out[rng.randrange(parts)].append(row)
    return out


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 4)])
def test_any_split_gives_the_same_edges(spark, tmp_path, seed, parts):
    rows = visits(11, 20, 10) * 2 + [(1, None, 2, datetime(2024, 1, 1)), (None, None, None, None)]
    put(spark, tmp_path, split(rows, seed, parts))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    follow_edges(event_files(spark, str(tmp_path / "in")), out, state)
    df = spark.createDataFrame(rows, "u bigint, i bigint, r int, ts timestamp_ntz").selectExpr("'t' AS dataset", "*")
    want = bipartite_edges(df)
    got = edges_now(spark, out).select(want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_it_goes_on_where_it_stopped(spark, tmp_path):
    first, second = visits(12, 15, 8), visits(13, 15, 8)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    put(spark, tmp_path, [first])
    follow_edges(event_files(spark, str(tmp_path / "in")), out, state)
    before = edges_now(spark, out).count()
    put(spark, tmp_path, [second])
    follow_edges(event_files(spark, str(tmp_path / "in")), out, state)
    df = spark.createDataFrame(first + second, "u bigint, i bigint, r int, ts timestamp_ntz").selectExpr("'t' AS dataset", "*")
    want = bipartite_edges(df)
    got = edges_now(spark, out).select(want.columns)
    assert before < got.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_days_close_and_late_events_are_counted(spark, tmp_path):
    start = datetime(2024, 1, 1, 12)
    days = [[(u, d, 1, start + timedelta(days=d)) for u in range(4)] for d in range(6)]
    late = [(9, 9, 1, start), (9, 9, 1, start + timedelta(hours=1))]  # after day 3, of day 0
    in_time = [(8, 8, 1, start + timedelta(days=4))]  # a day back only
    put(spark, tmp_path, [*days[:4], days[4] + late, days[5] + in_time, [(7, 7, 1, None)]])
    out = str(tmp_path / "out")
    query = follow_daily_edges(event_files(spark, str(tmp_path / "in")), out, str(tmp_path / "state"), "1 day")
    got = {(r.day, r.u, r.i, r.w) for r in spark.read.parquet(out).collect()}
    # the last event is of day 5, so the days up to 3 are closed
    assert got == {(date(2024, 1, 1) + timedelta(days=d), u, d, 1) for d in range(4) for u in range(4)}
    assert late_rows(query) == 1  # both are one partial sum, of one edge
