import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from graphloom.llm import exact_dedup, line_dedup, minhash
from graphloom.llm.components import components
from tests.llm import brute
from tests.llm.conftest import AWKWARD, edited, prose


def copies(seed=1):
    rng = random.Random(seed)
    texts = [prose(k, rng.randrange(1, 120)) for k in range(15)]
    rows = [(d, rng.choice(texts)) for d in range(70)]
    return rows + [(d + 200, t.replace(" ", "\t  ", 1)) for d, t in rows[:9]] + AWKWARD


@pytest.mark.parametrize("shard", [3, 8192])
def test_exact_by_brute_force(docs, shard):
    rows = copies()
    groups = defaultdict(list)
    for d, t in rows:
        groups[brute.WHITE.sub(" ", t or "")].append(d)
    want = {
        d: (min(ids), len(ids), d == min(ids), sha256(text.encode()).hexdigest()) for text, ids in groups.items() for d in ids
    }
    got = {r[0]: tuple(r)[1:] for r in exact_dedup.dedupe(docs(rows), shard).collect()}
    assert got == want
    kept = exact_dedup.without_copies(docs(rows))
    assert {r.doc_id for r in kept.collect()} == {d for d, w in want.items() if w[2]}
    assert kept.columns == docs(rows).columns


def test_exact_without_ids_or_rows(docs):
    assert exact_dedup.dedupe(docs([])).collect() == []
    got = exact_dedup.dedupe(docs([(None, "a"), (None, "a"), (5, "b"), (None, "b"), (5, "b")])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [
        ("5", "5", 3, True), ("5", "5", 3, True), ("None", "5", 3, False),
        ("None", "None", 2, True), ("None", "None", 2, True),
    ]


def test_perfect_hash_is_minimal_and_checks_bytes():
    words = np.random.default_rng(1).integers(0, 2**63, (5000, 4), dtype=np.uint64)
    hashed = exact_dedup.PerfectHash.build(words)
    assert sorted(hashed.slots(words)) == list(range(5000))
    equal = np.zeros((3, 4), np.uint64)
    equal[:, 3] = [1, 2, 3]  # no level parts these
    assert set(exact_dedup.PerfectHash.build(equal).slots(equal)) == {-1}
    raw = [w.tobytes() for w in equal]
    import pandas as pd

    index = exact_dedup._build_shard(pd.DataFrame({"shard": 0, "digest": raw, "winner": [7, 8, 9], "n": [1, 1, 1]}))
    other = np.array([0, 0, 0, 4], np.uint64).tobytes()
    found = exact_dedup._look_up(pd.DataFrame({"digest": [raw[1], other], "first": [20, 21], "n": [1, 1]}), index)
    assert found["known"].tolist() == [True, False] and found["winner"].tolist() == [8, None]


@pytest.mark.parametrize("broken", ["digests", "winners"])
def test_exact_groups_rest_on_the_look_up(docs, monkeypatch, broken):
    from pyspark.sql import functions as F

    rows = [(1, "a"), (2, "b"), (3, "c"), (98, "a"), (99, "b"), (100, "d")]
    right = {1: (1, 2), 2: (2, 2), 3: (3, 1), 98: (1, 2), 99: (2, 2), 100: (100, 1)}
    found = lambda: sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.dedupe(docs(rows)).collect())
    assert found() == [(d, *v) for d, v in right.items()]
    build = exact_dedup.build_index
    other = {
        "digests": F.unhex(F.reverse(F.hex("digests"))),
        "winners": F.transform("winners", lambda w: w + 10),
    }[broken]
    monkeypatch.setattr(exact_dedup, "build_index", lambda *a: build(*a).withColumn(broken, other))
    assert found() != [(d, *v) for d, v in right.items()]


@pytest.mark.parametrize("limit", [500_000, 0])
@pytest.mark.parametrize("module", [exact_dedup, minhash])
def test_one_row_of_replayed_rows_stays(docs, monkeypatch, module, limit):
    monkeypatch.setattr(module, "BROADCAST_ROWS", limit)
    a, b, c = (prose(k, 40, 1000) for k in range(3))
    rows = [(1, a)] * 30 + [(2, a)] * 5 + [(None, b)] * 20 + [(3, c), (4, None), (4, None), (5, prose(9, 40, 1000))]
    kept = module.without_copies(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted(
        (str(d), t) for d, t in [(1, a), (None, b), (3, c), (4, None), (5, prose(9, 40, 1000))]
    )


def near_copies():
    rng = random.Random(3)
    rows = []
    for group in range(6):
        text = prose(group, rng.randrange(20, 150), 1000)
        rows += [(len(rows) + k, edited(text, 100 * group + k, rng.randrange(0, 4))) for k in range(12)]
    chain = prose(77, 120, 1000).split(" ")
    for k in range(8):  # each like the next, the ends unlike each other
        rows.append((300 + k, " ".join(chain[8 * k : 8 * k + 60])))
    passage = prose(55, 40, 1000)
    rows += [(400 + k, f"{prose(500 + k, 60, 1000)} {passage}") for k in range(40)]
    rng.shuffle(rows)
    return rows + [(d + 1000, t.upper()) for d, t in rows[:5]] + AWKWARD


def test_near_copies_by_brute_force(docs):
    rows = near_copies()
    want = brute.components(rows)
    got = minhash.near_duplicates(docs(rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(rows) - 50
    sizes = {d: len(brute.shingles(t)) for d, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)
    kept = minhash.without_copies(docs(rows))
    assert {r.doc_id for r in kept.collect()} == set(want.values())
    assert kept.columns == docs(rows).columns


def test_near_copies_of_little(docs):
    assert minhash.near_duplicates(docs([])).collect() == []
    text = prose(1, 30)
    got = minhash.near_duplicates(docs([(None, text), (3, text), (3, text), (2, text + " end"), (4, None)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("2", "2", True), ("3", "2", False), ("3", "2", False), ("4", "4", True), ("None", "None", True)
    ]


def test_signatures_within_the_radius_share_a_key():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**16, minhash.SYMBOLS).astype(np.uint16)
    for _ in range(200):
        b = a.copy()
        at = rng.choice(minhash.SYMBOLS, minhash.RADIUS, replace=False)
        b[at] += rng.integers(1, 2**16, len(at)).astype(np.uint16)
        x, y = minhash.keys(np.stack([a, b]))
        assert set(x) & set(y)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    label = {x: x for pair in links for x in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(links + links[:9], "a bigint, b bigint")).collect()
    assert {r.id: r.label for r in got} == {k: v for k, v in label.items() if k != v}


@pytest.mark.parametrize("words", [1, 8, 30])
def test_lines_by_brute_force(docs, words):
    rng = random.Random(words)
    pool = [prose(k, rng.randrange(1, 9), 1000) for k in range(12)]
    rows = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))) for d in range(25)]
    rows += [(50, "\n".join([pool[0]] * 40)), (51, rows[3][1]), (52, rows[4][1] + "\n" + rows[5][1])] + AWKWARD
    want = brute.removed_lines(rows, words)
    got = line_dedup.dedupe(docs(rows), words)
    assert got.columns == [*docs(rows).columns, "n_removed"]
    for r in got.collect():
        text = dict(rows)[r.doc_id]
        gone = want.get((r.doc_id, text), set())
        assert r.n_removed == len(gone)
        assert r.text == (None if text is None else brute.without_lines(text, gone))
    assert sum(map(len, want.values())) > 0


def test_lines_of_little(docs):
    assert line_dedup.dedupe(docs([])).collect() == []
    run = "\n".join(prose(k, 20, 1000) for k in range(3))
    got = line_dedup.dedupe(docs([(2, run), (1, run), (1, run), (None, run), (3, "a\nb")])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 3), ("1", 3), ("2", 3), ("3", 0), ("None", 0)]
