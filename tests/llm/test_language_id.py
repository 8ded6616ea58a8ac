"""Language identification: held-out accuracy, and the kernel against its definition."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from topshare.llm import language_id
from topshare.llm.ngrams import ngram_codes
from topshare.llm.queries import op8_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_kernel(a, b):
    x, y = (set(ngram_codes(t, language_id.SHORTEST, language_id.LONGEST, language_id.BITS).tolist()) for t in (a, b))
    return len(x & y) / np.sqrt(len(x) * len(y))


def test_kernel_and_ridge_against_definition():
    texts = ["the cat and the dog", "a dog of the house", "le chat et le chien", "une maison de chat"]
    labels = np.array(["en", "en", "fr", "fr"])
    model = language_id._fit(texts, labels, 4)
    units = language_id._unit_presence(texts)
    kernel = np.array([[plain_kernel(a, b) for b in texts] for a in texts])
    assert np.allclose(units @ units.T, kernel, atol=1e-5)
    # With every text a landmark, Nyström features reproduce the kernel, and ridge regression its dual form.
    centre = np.eye(4) - 0.25
    goals = np.where(labels[:, None] == np.array(["en", "fr"]), 1.0, -1.0)
    dual = centre @ kernel @ centre
    fitted = dual @ np.linalg.solve(dual + language_id._RIDGE * np.eye(4), centre @ goals) + goals.mean(axis=0)
    assert np.allclose(units @ model.landmarks.T @ model.weights + model.bias, fitted, atol=1e-2)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, f"the cat and the dog number {i}", "en") for i in range(30)]
    rows += [(100 + i, f"le chat et le chien numéro {i}", "fr") for i in range(30)]
    rows += [(300, "not used", None), (None, "nor this", "xx"), (301, None, "yy"), (0, "repeated id", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return language_id.train(language_id.training_rows(docs, F.lit(True), 10))


def test_cases(spark, model):
    assert model.languages == ["en", "fr"]
    texts = ["the dog", "le chien", None, "", "12 34 !?", "the dog", "le chat et " * 30_000]
    rows = [(i, t, "lang", 1.0, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double, found string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.classify(frame, model).collect()}
    assert [found[i][0] for i in range(7)] == ["en", "fr", "und", "und", "und", "en", "fr"]
    assert found[2][1] == found[3][1] == found[4][1] == 0.0 and found[0] == found[5]
    kept = language_id.keep_identified(frame, model)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 5, 6}


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language_id.train(language_id.training_rows(empty, F.lit(True)))
    assert language_id.classify(empty, model).collect() == []
    one = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language_id.classify(one, model).collect()] == [(1, "und", 0.0)]


def test_one_language_alone(spark):
    docs = spark.createDataFrame([(1, "some text", "en"), (2, "more text", "en")], "doc_id long, text string, lang string")
    model = language_id.train(language_id.training_rows(docs, F.lit(True)))
    assert {r["lang_pred"] for r in language_id.classify(docs, model).collect()} == {"en"}


def test_nothing_learned_rejects_nothing(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert language_id.keep_identified(docs, language_id.train(language_id.training_rows(docs, F.lit(True)))).count() == 2


def test_training_rows_against_plain_ranking(spark):
    """Octaves choose what a ranking of all rows would, with a hot language, repeated rows and one id with two texts."""
    rows = [(i, f"text {i}", "hot" if i % 3 else ["a", "b", "c"][i % 9 // 3]) for i in range(6000)]
    rows += [(7, "text 7", "hot")] * 30 + [(8, "another", "hot"), (8, "b text", "a"), (9000, "rare", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.xxhash64("doc_id"))
    for limit in (1, 40, 400, 100_000):
        want = {}
        counts = {}
        for r in sorted(docs.collect(), key=lambda r: (r["h"], r["doc_id"])):
            counts[r["lang"]] = counts.get(r["lang"], 0) + 1
            if counts[r["lang"]] <= limit:
                want.setdefault((r["doc_id"], r["lang"]), None)
        chosen = {}
        for i, text, lang in rows:
            if (i, lang) in want:
                chosen[i] = min(chosen.get(i, (lang, text)), (lang, text))
        found = language_id.training_rows(docs.repartition(5), F.lit(True), limit).collect()
        assert sorted((r["lang"], r["text"]) for r in found) == sorted(chosen.values())


def test_scripts_of_thousands_of_characters():
    """Long texts in two languages that share a script of 5,000 characters are told apart, as short ones are."""
    rng = np.random.default_rng(1)
    common = rng.permutation(5000) + 0x4E00
    words = {
        name: ["".join(map(chr, rng.choice(common[low : low + 4000], 2))) for _ in range(3000)]
        for name, low in (("one", 0), ("two", 1000))
    }

    def text(name, n):
        return "".join(rng.choice(words[name], n))

    train = [(text(n, int(rng.integers(50, 3000))), n) for n in words for _ in range(60)]
    model = language_id._fit([t for t, _ in train], np.array([n for _, n in train]), 64)
    held = [(text(n, size), n) for n in words for size in (100, 10_000, 100_000) for _ in range(4)]
    assert model.predict([t for t, _ in held])[0] == [n for _, n in held]
    filled = len(language_id._grams(text("one", 100_000))) / language_id.SIZE
    assert filled < 0.5


def test_batches_do_not_change_scores(model):
    texts = ["the dog", "le chien " * 50_000, "", "the cat and " * 3, "le chat"]
    alone = [model.predict([t]) for t in texts]
    together = model.predict(texts)
    assert together[0] == [a[0][0] for a in alone] and np.array_equal(together[1], [a[1][0] for a in alone])
