import random
import sys
from collections import defaultdict
from datetime import date, datetime, timedelta
from itertools import combinations
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from graphloom.session import local_session  # noqa: E402

TINY = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "tests", str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


def visits(seed: int, users: int = 60, items: int = 40) -> list[tuple]:
    """(u, i, r, ts) with one item that most users have, and a few other large ones."""
    rng = random.Random(seed)
    share = {0: 0.9, 1: 0.6, 2: 0.5, 3: 0.4}
    rows = []
    for u in range(users):
        for i in range(items):
            if rng.random() < share.get(i, 0.05):
                day = datetime(2024, 1, 1) + timedelta(days=rng.randrange(60), hours=rng.randrange(24))
                rows.append((u, i, rng.choice([1, 2, 3, 4, 5, None]), day))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "u bigint, i bigint, r int, ts timestamp_ntz").selectExpr(
        "'t' AS dataset", "*"
    )


def shared(pairs: list[tuple]) -> dict[tuple, int]:
    """Brute force: shared keys per pair of nodes, from (key, node)."""
    nodes = defaultdict(set)
    for key, node in pairs:
        nodes[key].add(node)
    weight = defaultdict(int)
    for members in nodes.values():
        for pair in combinations(sorted(members), 2):
            weight[pair] += 1
    return dict(weight)


def near(rows: list[tuple], days: int, same_item: bool) -> set[tuple]:
    """Brute force: users with an equal grade at most ``days`` calendar days apart."""

    def day(ts: datetime) -> date:
        return ts.date()

    found = set()
    for u, i, r, ts in rows:
        for u2, i2, r2, ts2 in rows:
            if u < u2 and r is not None and r == r2 and (i == i2 or not same_item):
                if abs((day(ts) - day(ts2)).days) <= days:
                    found.add((u, u2))
    return found
