import pickle
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from graphloom.llm import gbt, langid, quality, toxicity
from graphloom.llm.queries import queries
from tests.conftest import SMALL
from tests.llm.conftest import AWKWARD, prose


def held_out(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def truth(column):
    rows = duckdb.sql(f"SELECT doc_id, {column} FROM '{SMALL}/labels.parquet'").fetchall()
    return dict(rows)


@pytest.mark.parametrize("name, column, folds, fold, least", [("op2_quality", "quality", 4, 2, 0.95), ("op8_toxicity", "toxic", 3, 1, 0.93)])
def test_held_out_accuracy(spark, name, column, folds, fold, least):
    got = queries()[name](spark, SMALL).collect()
    labels = truth(column)
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == held_out(r.doc_id, folds, fold) for r in got)
    judged = [r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id in labels]
    assert len(judged) > 80 and np.mean(judged) >= least


def test_language_of_held_out_documents(spark):
    got = queries()["op9_langid"](spark, SMALL).collect()
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SMALL}/documents.parquet'").fetchall())
    judged = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out]
    assert len(judged) > 200 and np.mean(judged) >= 0.98
    assert all(r.held_out == held_out(r.doc_id, 4, 2) for r in got)


def test_labels_of_the_held_out_fold_change_nothing(spark, docs):
    rows = [(d, prose(d, 30) + (" scum trash" if d % 3 == 0 else "")) for d in range(90)]
    labels = [(d, int(d % 3 == 0), int(d % 3 == 0)) for d, _ in rows]
    other = [(d, 1 - q, 1 - t) if held_out(d, 3, 1) else (d, q, t) for d, q, t in labels]
    schema = "doc_id bigint, quality int, toxic int"
    table = docs(rows)
    first, second = (toxicity.op8(table, spark.createDataFrame(x, schema)) for x in (labels, other))
    assert sorted(first.collect()) == sorted(second.collect())


def test_awkward_rows_are_scored(spark, docs):
    table = docs([*AWKWARD, (None, "text"), (903, "one")])
    labels = spark.createDataFrame([(903, 1, 0), (904, 0, None), (None, 1, 1), (77, 1, 1), (903, 0, 1)], "doc_id bigint, quality int, toxic int")
    for labelled in (labels, labels.limit(0)):
        for op in (quality.op2, toxicity.op8):
            got = op(table, labelled).collect()
            assert len(got) == len(AWKWARD) + 2 and all(0 <= r.score <= 1 for r in got)
            assert op(table.limit(0), labelled).collect() == []
    model = toxicity.fit(table, labels)
    scored = toxicity.score(table, model)
    assert scored.columns == table.columns  # score and predicted were there, and are replaced
    assert toxicity.clean(table, model).columns == table.columns


def test_second_person_density_holds_at_any_length():
    for word in sorted(toxicity.YOU):
        text = f"{word} one two three four "
        short, long = (toxicity.features([text * n], {})[0] for n in (10, 500))
        assert short[21] == long[21] == 0.2, word


@pytest.mark.parametrize("mark", list("0123456789@$*!"))
def test_masked_words_are_found_by_any_mark(mark):
    found = toxicity.features([f"you are an id{mark}ot", f"you are an id{mark}ot " + "and so on " * 11_000], {})
    assert (found[:, 17] > 0).all()
    assert (found[:, 19] == (mark == "!")).all()  # only ! stands for an i


def test_spelt_words_are_found_in_long_texts():
    short, long = toxicity.features(["i-d-i-o-t", "and so on " * 11_000 + "i-d-i-o-t"], {})
    assert short[18] > 0 and long[18] > 0 and short[19] == long[19] == 1


def test_disguises_take_no_quadratic_time():
    texts = ["_" * 100_000 + " 2", "a" + "1" * 100_000, "a-" * 50_000 + " 2", "a " * 50_000, "!" * 100_000 + "a"]
    assert [x[17] > 0 for x in toxicity.features(texts, {})] == [False, False, False, False, True]


def test_languages_of_awkward_rows(spark, docs):
    got = langid.op9(docs([*AWKWARD, (None, "text")])).collect()
    assert len(got) == len(AWKWARD) + 1 and {r.lang_pred for r in got} == {"und"}
    rows = [(d, "der die das und" if d % 2 else "the of and", "de" if d % 2 else "en") for d in range(40)]
    rows += [(d, t, None) for d, t in AWKWARD] + [(50, "undder", None), (51, "4 5 ! ² Ⅷ", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.op9(table).collect()}
    assert found[900] == found[901] == found[51] == ("und", 0.0)
    assert found[50][0] == "de" and found[1][0] == "de" and found[2][0] == "en"


def test_language_counts_reach_the_driver_without_rows_of_python(spark, monkeypatch):
    """The model is that of a pivot of the counts, and is the same once sent."""
    rows = [(d, "der die das und é" if d % 2 else "the of and die", "de" if d % 2 else "en") for d in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for name in ("toPandas", "collect"):
        monkeypatch.setattr(type(table), name, lambda self: pytest.fail("rows of Python"))
    model = langid.fit(table)
    monkeypatch.undo()
    counted = Counter((w, r[2]) for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 for w in r[1].split())
    words = sorted({w for w, _ in counted})
    assert model.languages == ["de", "en"] and model.words == {w: k for k, w in enumerate(words)}
    values = np.array([[counted[w, lang] + 0.1 for lang in model.languages] for w in words])
    assert np.allclose(model.word_rows, np.log(values / values.sum(axis=0)))
    sent = pickle.loads(pickle.dumps(model))
    assert (sent.words, sent.grams, sent.languages) == (model.words, model.grams, model.languages)
    assert (sent.word_rows == model.word_rows).all() and (sent.gram_rows == model.gram_rows).all()
    empty = pickle.loads(pickle.dumps(langid.Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))))
    assert empty.words == {} and empty.grams == {}


def test_trees_learn_and_flat_arrays_walk_right():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = gbt.fit_trees(x[:1500], y[:1500])
    assert ((trees.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = (trees.left if row[trees.feature[node]] <= trees.threshold[node] else trees.right)[node]
            total += trees.value[node]
        return total

    assert np.allclose(trees.margin(x[:50]), [walk(r) for r in x[:50]])


def test_trees_of_little():
    assert gbt.fit_trees(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    one = gbt.fit_trees(np.zeros((5, 3)), np.ones(5))
    assert (one.probability(np.zeros((2, 3))) > 0.5).all()


def test_isotonic_steps_rise_and_keep_the_mean():
    rng = random.Random(1)
    score = np.array([rng.random() for _ in range(300)])
    y = np.array([float(rng.random() < s) for s in score])
    fitted = gbt.fit_isotonic(score, y)
    assert (np.diff(fitted(np.sort(score))) >= 0).all()
    assert abs(fitted(score).mean() - y.mean()) < 1e-9
    assert gbt.fit_isotonic(score, np.ones(300))(score).tolist() == score.tolist()
