import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece

from graphloom.llm import fim, token_counts
from tests.conftest import SMALL
from tests.llm.conftest import AWKWARD, prose

PIECES = public_tokenizers.path("piece_bpe_32k.model")
UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain_form(doc_id, text, seed=42, percent=50, spm=80):
    """The transformation as its rule reads: n, form, prefix, middle, output."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    assert "".join(units) == text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(n=300):
    rng = random.Random(3)
    parts = ["a", "é", "中文", "😀", " ", "\n", "  ", "\t\r", "<", "<P", ">", "M>", "<S", "word", "\x00", "\xa0"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(n)]
    return made + ["has <P> in it", "<S>", "x<M>"]


@pytest.mark.parametrize("percent,spm", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_forms_by_the_plain_rule(docs, percent, spm):
    rows = [*enumerate(texts()), *AWKWARD]
    made = fim.transform(docs(rows), percent=percent, spm=spm)
    got = {r.doc_id: r for r in fim.restore(made).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        r = got[doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_form(doc_id, text or "", 42, percent, spm)
        assert r.restored == (text or "")


def test_every_cut_of_a_text_comes_back():
    for text in ("", "a", " a\n", "ab <P cd <", "éé 中 <S"):
        raw = text.encode()
        for first in range(len(raw) + 1):
            for last in range(first, len(raw) + 1):
                for form in (fim.PSM, fim.SPM, fim.PLAIN):
                    assert fim.restored(fim.arrange(raw, first, last, form), form) == raw


def test_rotation_lets_blocks_change_places():
    buffer = bytearray(b"0abcXY9")
    fim.rotate(buffer, 1, 4, 6)
    assert buffer == b"0XYabc9"
    fim.rotate(buffer, 1, 3, 6)
    assert buffer == b"0abcXY9"


def test_forms_of_little(docs):
    assert fim.op11(docs([])).collect() == []
    got = fim.op11(docs([(None, "a b"), (None, None), (1, "x y z"), (1, "x y z"), (1, "other")])).collect()
    assert sorted((str(r.doc_id), r.n) for r in got) == [("1", 1), ("1", 3), ("1", 3), ("None", 0), ("None", 2)]
    twice = [r for r in got if r.doc_id == 1 and r.n == 3]
    assert twice[0] == twice[1]
    assert all(r.output_sha256 and r.restored_sha256 for r in got)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_counts_are_those_of_the_library(spark, library):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in token_counts.count_tokens(rows, PIECES).collect()}
    for r in rows.select("doc_id", "text").collect():
        n = len(library.encode(r.text or ""))
        want = (len((r.text or "").encode()), n, n > 4096)
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == want


def test_counts_of_awkward_texts(docs, library):
    rows = [*enumerate(texts() + ["<s> a </s><unk><0x0A>", "▁▁▁ a▁b", " lead", "trail ", "\n", "a\n\n b"]), *AWKWARD]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(rows), PIECES).collect()}
    assert got == {d: len(library.encode(t or "")) for d, t in rows}


def test_merging_one_by_one_gives_the_same(monkeypatch):
    """The heap against a search for the best pair after each merge; kept words against none kept."""
    merges = token_counts.counter(PIECES).merges

    def plain(word):
        symbols = list(word)
        while True:
            found = [(merges.rank[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in merges.rank]
            if not found:
                return sum(1 if s in merges.rank else len(s.encode()) for s in symbols)
            k = min(found)[1]
            symbols[k : k + 2] = ["".join(symbols[k : k + 2])]

    rng = random.Random(8)
    for _ in range(400):
        word = "▁" * rng.randrange(3) + "".join(rng.choice("aeinrstthé中1.{;\r") for _ in range(rng.randrange(1, 15)))
        assert merges.count(word) == plain(word) == sum(map(plain, merges.parts(word)))
    monkeypatch.setattr(token_counts, "CACHE", 3)
    monkeypatch.setattr(token_counts, "LONGEST", 4)
    small = token_counts.Counts(PIECES)
    text = prose(5, 200)
    assert small.count(text) == len(small.model.encode(text))


def test_counts_of_little(docs):
    assert token_counts.count_tokens(docs([]), PIECES).collect() == []
    got = token_counts.count_tokens(docs([(None, None), (1, "a b"), (1, "a b")]), PIECES, limit=1).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [
        ("1", 3, 2, True), ("1", 3, 2, True), ("None", 0, 0, False),
    ]
