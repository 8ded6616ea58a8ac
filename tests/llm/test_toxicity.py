"""Toxicity: held-out quality, and training against plain counts."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from topshare.llm import toxicity
from topshare.llm.queries import op5_toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op5_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert sum(a and b for a, b in held) >= 0.6 * sum(a for a, _ in held)


def frames(spark, n=40):
    rows = [(i, f"a fine and friendly text {i} about the garden") for i in range(n)]
    rows += [(1000 + i, f"you are such a blorgling {i} indeed") for i in range(n)]
    rows += [(5000, None), (5001, ""), (None, "no id")]
    docs = spark.createDataFrame([(*r, 0.5, 7) for r in rows], "doc_id long, text string, score double, toxic int")
    marks = [(i, 0) for i in range(n)] + [(1000 + i, 1) for i in range(n)] + [(1000, 1), (5, None), (None, 1), (9999, 1)]
    return docs, spark.createDataFrame(marks, "doc_id long, toxic int")


def test_learns_and_scores_cases(spark):
    docs, labels = frames(spark)
    rows = toxicity.training_rows(docs, labels)
    assert rows.count() == 80
    model = toxicity.train(rows)
    new = [(1, "what a blorgling"), (2, "a friendly garden"), (3, None), (4, ""), (5, "blorgling " * 30_000), (2, "a friendly garden")]
    frame = spark.createDataFrame([(*r, "s", "p") for r in new], "doc_id long, text string, score string, predicted string")
    found = toxicity.classify(frame, model).collect()
    assert {(r["doc_id"], r["predicted"]) for r in found if r["doc_id"] not in (3, 4)} == {(1, 1), (2, 0), (5, 1)}
    assert len(found) == len(new)  # texts without n-grams get what the bias alone says
    assert len({r["score"] for r in found if r["doc_id"] in (3, 4)}) == 1
    kept = toxicity.drop_toxic(frame, model)
    left = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == frame.columns and left == {r["doc_id"] for r in found if not r["predicted"]}


def test_limit_and_partitioning_do_not_change_the_model(spark):
    docs, labels = frames(spark)
    one = toxicity.train(toxicity.training_rows(docs, labels, 30))
    two = toxicity.train(toxicity.training_rows(docs.repartition(7), labels.repartition(5), 30))
    assert np.allclose(one.weights, two.weights) and one.bias == pytest.approx(two.bias)
    assert toxicity.training_rows(docs, labels, 30).count() <= 30


@pytest.mark.parametrize(("toxic", "score"), [(0, 0.0), (1, 1.0)])
def test_one_label_alone(spark, toxic, score):
    docs, labels = frames(spark)
    model = toxicity.train(toxicity.training_rows(docs, labels.where(F.col("toxic") == toxic)))
    assert {round(r["score"], 3) for r in toxicity.classify(docs, model).collect()} == {score}


def test_empty_tables(spark):
    docs, labels = frames(spark)
    model = toxicity.train(toxicity.training_rows(docs.limit(0), labels.limit(0)))
    assert toxicity.classify(docs.limit(0), model).collect() == []
    assert all(r["predicted"] == 0 for r in toxicity.classify(docs, model).collect())


def test_ratio_against_definition(spark):
    docs, labels = frames(spark)
    model = toxicity.train(toxicity.training_rows(docs, labels))
    code = toxicity.ngram_codes("blorg", 5, 5, toxicity.BITS)
    inner = toxicity.ngram_codes("blorg", 3, 5, toxicity.BITS)
    assert len(code) == 3 and len(inner) == 12  # between two spaces
    ratio = np.log(41 / 42) - np.log(1 / 42)  # in all 40 toxic texts and no other
    assert np.isclose(model.squares[code[1]], ratio**2, rtol=1e-4)
