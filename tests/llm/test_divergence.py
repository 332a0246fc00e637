import random
import re
from collections import Counter, defaultdict

import pytest

from graphloom.llm import divergence
from tests.llm.brute import lower

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ROWS = "doc_id bigint, text string, lang string, source string, value double, rank string, term string"


def plain(rows, documents=3, terms=200):
    """The rule with a dense table of shares."""
    docs = [(lang or "", source or "", TERM.findall(lower(text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        held, counts = Counter(), defaultdict(Counter)
        for one, source, found in docs:
            if one == lang:
                counts[source].update(found)
                held.update(set(found))
        kept = [t for t, n in held.items() if n >= documents]

        def shares(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        p = {source: shares(count) for source, count in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for source in counts:
            pairs = {s: sum((p[source][t] - p[s][t]) ** 2 // p[s][t] for t in kept) for s in counts if s != source}
            best = {
                t: (p[source][t] - q[t]) ** 2 // q[t] for t in kept if counts[source][t] and p[source][t] > q[t]
            }
            for part, values, limit in (("pair", pairs, None), ("term", best, terms)):
                order = sorted(values.items(), key=lambda v: (-v[1], v[0].encode()))
                out |= {(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(order[:limit])}
    return out


def audited(spark, rows, parts=4, **how):
    full = [(*row, 1.5, "clash", "clash") for row in rows]
    found = divergence.audit(spark.createDataFrame(full, ROWS).repartition(parts), **how).collect()
    got = {tuple(r) for r in found}
    assert len(got) == len(found)
    return got


def many(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)] + ["É", "é", "中文", "K", "ſ", "A-b", "x1y", "12", "a\xa0b", "😀z"]
    rows = []
    for k in range(n):
        size = rng.choice([0, 1, 5, 40])
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", ",", " \t", "\x0b", "\x1c"]) for _ in range(size))
        rows.append((k, text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "S3", None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_plain_rule(spark, seed):
    rows = many(seed)
    assert audited(spark, rows) == plain(rows)
    assert audited(spark, rows, terms=3) == plain(rows, terms=3)
    assert audited(spark, rows, documents=2) == plain(rows, 2)


def test_sums_given_out_often_add_up(spark, monkeypatch):
    rows = many(3)
    docs = spark.createDataFrame([(*row, 1.5, "", "") for row in rows], ROWS).coalesce(1)
    whole = {tuple(r) for r in divergence.term_counts(divergence.chunk_counts(docs)).collect()}
    monkeypatch.setattr(divergence, "HELD", 5)
    assert divergence.chunk_counts(docs).count() > 100
    assert {tuple(r) for r in divergence.term_counts(divergence.chunk_counts(docs)).collect()} == whole


def test_chunk_counts_are_shuffled_packed(spark):
    """What is shuffled holds no last row, as most chunks have one document; sums are as counted by hand."""
    docs = spark.createDataFrame([(k, t, "x", "s") for k, t in enumerate(["a, a b", "b c", "", "(a)"])], "doc_id bigint, text string, lang string, source string")
    sums = divergence.chunk_counts(docs.coalesce(1))
    dealt = sums._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "span#" in dealt and "last#" not in dealt
    want = {(b"a", 3, 2, 0, 3), (b"b", 2, 2, 0, 1), (b"c", 1, 1, 1, 1)}
    assert {tuple(r)[2:] for r in sums.collect()} == want and sums.columns == [c.split()[0] for c in divergence.COUNTS.split(", ")]


def test_terms_are_shuffled_once(spark, monkeypatch):
    """Sums per term and group, and what is kept of them, take one shuffle; sums given out often add up."""
    rows = [*many(4), (-1, "a, É-é (A)b" + "x" * 20_000, None, "s1"), (-2, "b\x00a中 K b", None, "s1")]
    docs = spark.createDataFrame([(*row, 1.5, "", "") for row in rows], ROWS).coalesce(2)
    want = Counter()
    for _, text, lang, source in rows:
        want.update({(lang or "", source or "", t, "n"): n for t, n in Counter(TERM.findall(lower(text))).items()})
        want.update((lang or "", source or "", t, "docs") for t in set(TERM.findall(lower(text))))
    monkeypatch.setattr(divergence, "HELD", 5)
    sums = divergence.term_sums(docs)
    got = {(r.lang, r.source, bytes(r.term).decode(), k): r[k] for r in sums.collect() for k in ("n", "docs")}
    assert got == want and sums.count() * 2 == len(want)
    per_lang = sums.groupBy("lang", "term").agg({"docs": "sum"})
    plan = per_lang._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("start", [0, 10**14])
def test_documents_of_a_term_are_counted_up_to_three(spark, start):
    """Sums of rows of one term, against the distinct rows that they name."""
    rng = random.Random(start)
    rows, want = [], {}
    for k in range(300):
        named = set()
        for c in range(rng.randrange(1, 5)):
            docs = sorted(start + rng.randrange(6) for _ in range(rng.choice([1, 2])))
            docs = docs if docs[0] != docs[-1] else docs[:1]
            rows.append(("x", "s", f"{c}term{'abcdefghij'[k % 10] * (k // 10 + 1)}".encode(), 1, len(docs), docs[0], docs[-1]))
            named |= set(docs)
        want[rows[-1][2][1:].decode()] = min(3, len(named))
    rows.append(("x", "s", b"often", 9, 7, start, start + 6))
    sums = spark.createDataFrame(rows, divergence.COUNTS).repartition("chunk")
    got = {r.term: r.docs for r in divergence.term_counts(sums).collect()}
    assert got == want | {"often": 3} and set(want.values()) == {1, 2, 3}


def test_documents_of_a_term_over_several_chunks(spark):
    """Three documents, each with the term in another chunk, keep it; one document with three does not."""
    rows = [(1, "far, near! near? near.", "x", "a"), (2, "far.", "x", "a"), (3, "far", "x", "b"), (3, "else", "x", "b")]
    got = audited(spark, rows)
    assert got == plain(rows)
    assert {r[3] for r in got if r[2] == "term"} <= {"far"}


def test_little_and_odd(spark):
    assert audited(spark, []) == set()
    assert audited(spark, [(1, "alone", "x", "a")]) == set()
    rows = [(1, None, None, None), (None, "", "", "b"), (None, "1 2 3", "", "c"), (4, "a " * 5, "", "c")]
    got = audited(spark, rows)
    assert got == plain(rows) and len(got) == 6 and all(r[4] == 0 for r in got)
    rows = [(7, "same words here " + "long" * 20_000, "x", s) for s in "aabbc"] + [(7, None, "x", "d")]
    assert audited(spark, rows) == plain(rows)


def test_a_hot_group_and_words_of_all(spark):
    rows = [(k, "the of the " + f"own{'abcdefgh'[k % 8]} " * (k % 5), "x", "hot" if k % 3 else f"s{k % 7}") for k in range(400)]
    assert audited(spark, rows, 7) == plain(rows)
