import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, pii
from graphloom.llm.common import checked_broadcast
from tests.llm import brute
from tests.llm.conftest import AWKWARD, prose

ITEMS = [
    (10, prose(900, 25)),
    (2, "only Four words here"),
    (3, prose(901, 10, 1000)),
    (33, prose(901, 10, 1000)),
    (4, None),
    (5, " ... "),
    (None, prose(902, 20)),
    (6, "École ÉCOLE straße 1 2 3 4 5 6 7 8"),
]


def contaminated():
    rng = random.Random(1)
    rows = [(d, prose(d, rng.randrange(5, 60))) for d in range(30)]
    for d in range(30, 60):
        item = rng.choice([t for i, t in ITEMS if t and i])
        words = item.split()
        part = words[rng.randrange(3) :][: rng.randrange(8, 30)]
        rows.append((d, f"{prose(d, 20)}, {' -- '.join(part).upper()}! {prose(d + 100, 9)}"))
    rows.append((70, " ".join([ITEMS[2][1]] * 300)))
    return rows + AWKWARD + [(71, rows[40][1]), (72, "only four, WORDS: here only four words here")]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_windows_by_brute_force(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    rows = contaminated()
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    known = [(i, t) for i, t in ITEMS if i is not None]
    got = decontaminate.report(docs(rows), items).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = brute.contamination(dict(rows)[r.doc_id], known)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0), r.doc_id
        assert sum(s["to"] - s["at"] + 1 for s in r.spans) == hit
    dirty = {r.doc_id for r in got if r.contaminated}
    assert 5 < len(dirty) < 50
    left = decontaminate.clean(docs(rows), items)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - dirty
    assert left.columns == docs(rows).columns


def test_windows_of_little(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = decontaminate.report(docs(AWKWARD), none).collect()
    assert len(got) == len(AWKWARD) and not any(r.contaminated for r in got)
    assert decontaminate.report(docs([]), none).collect() == []
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate.report(docs([(None, ITEMS[0][1]), (1, "x"), (1, ITEMS[0][1])]), items).collect()
    assert sorted((str(r.doc_id), r.contaminated) for r in got) == [("1", False), ("1", True), ("None", True)]


def test_nothing_is_broadcast_beyond_its_bound(spark):
    big = spark.range(10)
    plain = checked_broadcast(big, 11, 10)
    assert plain is big and checked_broadcast(big, 10, 10) is not big


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


PERSONAL = [
    (1, "Write to Ann.Lee+x@Mail.example.com or ann.lee+x@mail.example.com, IP 10.1.2.3."),
    (2, "Call +1 (017) 555-7713 or +1 017 555 7713; card 4785 3805 9239 1139, 4785380592391139!"),
    (3, "No card: 9807915762804490, no address: 1.2.3.4.5 or 999.1.1.1, year 2024, a@b"),
    (4, "SSN 123-45-6789. IBAN DE89 3704 0044 0532 0130 00"),
    (5, "Mr. John Smith met Mrs. Anna Smith, and Mr. Smith left. Госпожа Анна Иванова"),
    (6, "10.1.2.3 again, ann.lee+x@mail.example.com"),
]


def test_surrogates_keep_kind_form_and_coreference(docs):
    rows = PERSONAL + AWKWARD
    got = {r.doc_id: r for r in pii.replace(docs(rows), "k").collect()}
    for d, t in rows:
        if d >= 900 or d == 3:
            assert got[d].text == t and got[d].n_entities == 0 and got[d].kinds == []
    for secret in ("ann.lee", "10.1.2.3", "555-7713", "4785", "123-45", "DE89 3704", "John", "Anna", "Smith", "Анна", "Иванова"):
        assert not any(secret.lower() in got[d].text.lower() for d, _ in PERSONAL), secret
    mails = re.findall(r"[\w.+]+@[\w.]+\w", got[1].text) + re.findall(r"[\w.+]+@[\w.]+\w", got[6].text)
    assert len(mails) == 3 and len({m.lower() for m in mails}) == 1 and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\+[a-z]@.+", mails[1])
    assert got[1].text.split("IP ")[1].rstrip(".") == got[6].text.split(" ")[0]
    phones = re.findall(r"\+1 [()\d -]+\d(?= or|;)", got[2].text)
    assert [re.sub(r"\d", "0", p) for p in phones] == ["+0 (000) 000-0000", "+0 000 000 0000"]
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1
    spaced, plain = re.search(r"card ([\d ]+), (\d+)!", got[2].text).groups()
    assert spaced.replace(" ", "") == plain and luhn(plain) and plain != "4785380592391139"
    assert re.fullmatch(r"SSN \d{3}-\d\d-\d{4}\. IBAN DE\d\d( \d{4}){4} \d\d", got[4].text)
    male, surname, female, surname2, surname3 = re.match(
        r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+), and Mr\. (\w+) left", got[5].text
    ).groups()
    assert surname == surname2 == surname3 and male != female
    assert re.search(r"Госпожа [А-Я][а-я]+ [А-Я][а-я]+$", got[5].text)
    assert got[2].kinds == ["card", "phone"] and got[2].n_entities == 4
    clash = docs(rows).withColumn("text_key", F.lit(7)).withColumn("kinds", F.lit("own"))
    again = pii.replace(clash, "k")
    assert {r.doc_id: (r.text, r.text_key) for r in again.collect()} == {d: (r.text, 7) for d, r in got.items()}
    other = {r.doc_id: r.text for r in pii.replace(docs(PERSONAL), "another key").collect()}
    assert all(other[d] != got[d].text for d in (1, 2, 4, 5, 6))


def test_names_go_wherever_their_text_has_them(docs):
    rows = [
        (1, "Mr. John Smith came. John Smith paid, and Smith left. Dr. John Smith is Mr. John Smith. Smithy, a john"),
        (2, "John Smith has no title here. Dr. John Smith-Lee has: John, Smith-Lee."),
        (3, "Mrs. Ann Dr. Ann Bell and Mr. Ann Bell; mail Ann.Bell@mail.example.com"),
        (4, "Señora María Íñiguez dijo: María y O’Neil. Herr O’Neil, O’Neil"),
    ]
    got = {r.doc_id: r for r in pii.replace(docs(rows), "k").collect()}
    given, surname = re.match(r"Mr\. (\w+) (\w+) came", got[1].text).groups()
    want = f"Mr. {given} {surname} came. {given} {surname} paid, and {surname} left. Dr. {given} {surname} is Mr. {given} {surname}. Smithy, a john"
    assert got[1].text == want and got[1].n_entities == 9 and got[1].kinds == ["name_m", "surname"]
    assert len({given, surname, "John", "Smith"}) == 4
    first, rest = re.match(r"(\w+) Smith has no title here\. Dr\. (.+)", got[2].text).groups()
    assert re.fullmatch(rf"{first} (\w+) has: {first}, \1\.", rest) and first != "John"
    assert first[:4] == given[:4]  # one body; in one text the titles tell the gender
    assert not re.search("Ann|Bell", got[3].text) and "name_n" in got[3].kinds
    assert not re.search("María|Íñiguez|O’Neil", got[4].text) and got[4].text.count("dijo") == 1


def test_short_numbers_are_no_phones_and_crowded_ones_grow(spark, docs):
    assert [r.text for r in pii.replace(docs([(1, "+12345 or +1 23 45")]), "k").collect()] == ["+12345 or +1 23 45"]
    value = spark.createDataFrame([("phone", "12345678"), ("ip", "1.2.3.4"), ("ssn", "123456789")], "kind string, value string")
    for attempt, more in ((0, 0), (pii.LONGER, 1), (3 * pii.LONGER, 3)):
        made = pii.surrogate(F.col("kind"), F.col("value"), F.lit(attempt), "k")
        got = {r.kind: r.new for r in value.select("kind", made.alias("new")).collect()}
        assert len(got["phone"]) == 8 + more and len(got["ssn"]) == 9 + more and got["ip"].count(".") == 3 + (more > 0)
    shown = spark.range(1).select(pii._in_form(F.lit("phone"), F.lit("+12 345-678"), F.lit("1999999944"))).first()[0]
    assert shown == "+19 999-99944"


def test_clashing_surrogates_get_another_attempt(spark, docs):
    """Many short names and addresses: there are far fewer first surrogates than entities."""
    names = [f"Mr. {a}{b}{c}o" for a in "BCDFGHKL" for b in "aeiou" for c in "bcdfghklmn"]
    rows = [(k, f"{n} and {n.lower()[4:]}.{k % 10}@mail1.example.com") for k, n in enumerate(names)]
    table = docs(rows)
    units = table.select(F.explode(pii.entities(F.col("text"))).alias("m")).select(F.explode(pii.parts(F.col("m"))).alias("u"))
    units = units.filter("u.kind IS NOT NULL").select(
        F.col("u.kind").alias("kind"), pii.canonical(F.col("u.kind"), F.col("u.value")).alias("value")
    )
    tried = pii.attempts(units, "k")
    assert tried.count() > 0
    got = {r.doc_id: r.text for r in pii.replace(table, "k").collect()}
    made = [re.match(r"Mr\. (\w+) and (\S+)$", got[k]).groups() for k, _ in rows]
    assert len({a for a, _ in made}) == len({b for _, b in made}) == len(rows)
    real = {n.lower()[4:] for n in names}
    assert not real & {a.lower() for a, _ in made}


def test_long_words_take_no_quadratic_time(docs):
    rows = [(1, "x" * 200_000), (2, "1" * 200_000), (3, "x.y-" * 50_000), (4, "9 " * 50_000)]
    assert {r.doc_id: r.n_entities for r in pii.replace(docs(rows), "k").collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


def test_personal_data_of_little(docs):
    assert pii.replace(docs([]), "k").collect() == []
    got = pii.replace(docs([(None, "10.9.8.7"), (1, "10.9.8.7"), (1, "10.9.8.7")]), "k").collect()
    assert len(got) == 3 and len({r.text for r in got}) == 1 and got[0].text != "10.9.8.7"
