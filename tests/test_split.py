import random
from datetime import datetime, timedelta

import pytest

from graphloom.operators import split
from tests.conftest import frame, visits


def plain_cut(rows, percent):
    times = sorted(ts for *_, ts in rows if ts)
    return times[-(-len(times) * percent // 100) - 1]


@pytest.mark.parametrize("percent", [1, 33, 50, 80, 100])
def test_the_cut_is_exact(spark, monkeypatch, percent):
    monkeypatch.setattr(split, "BUCKETS", 7)
    rng = random.Random(percent)
    rows = visits(1, 20, 10) + [(1, 1, 1, None)]
    rows += [(k, k, 1, datetime(1969, 12, 31) + timedelta(microseconds=rng.randrange(10**12))) for k in range(300)]
    rows += [(k, 7, 1, datetime(2024, 1, 5, 1, 2, 3, 4)) for k in range(150)]  # many at one time
    df = frame(spark, rows)
    cut = plain_cut(rows, percent)
    assert split.time_at(df, percent) == cut
    parts = {}
    seen = {(u, i) for u, i, _, ts in rows if ts and ts <= cut}
    for u, i, r, ts in rows:
        part = None if ts is None else "train" if ts <= cut else "known" if (u, i) in seen else "test"
        parts[part] = parts.get(part, 0) + 1
    got = split.time_split(df, percent)
    assert {r.part: r["count"] for r in got.groupBy("part").count().collect()} == parts
    assert got.columns == [*df.columns, "part"] and got.count() == len(rows)


def test_nothing_is_sorted(spark):
    plan = split.time_split(frame(spark, visits(1)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" not in plan and "Window" not in plan


def test_little(spark):
    assert split.time_at(frame(spark, []), 80) is None
    assert split.time_split(frame(spark, [])).collect() == []
    rows = [(1, 1, 1, None), (1, 1, 1, datetime(2024, 1, 1)), (1, 1, 1, datetime(2024, 1, 2)), (None, 1, 1, datetime(2024, 1, 2))]
    got = split.time_split(frame(spark, rows), 33).collect()
    assert sorted((str(r.u), str(r.part)) for r in got) == [("1", "None"), ("1", "known"), ("1", "train"), ("None", "test")]
    with pytest.raises(ValueError):
        split.time_at(frame(spark, rows), 0)
