"""Registered queries of the package: names, SQL, and the pipeline against its parts done plainly."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import oracle
from test_packing import check, expected
from test_simhash import plain_components, plain_fingerprint
from topshare.llm import queries

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    import __spark_entry__ as entry

    assert queries.QUERIES.items() <= entry.queries().items() and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF) == []


def test_pipeline_stages(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    columns, labels = docs.columns, {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        steps[name] = (before, docs)
    known, left = (f.collect() for f in steps["language_id"])
    assert steps["language_id"][1].columns == columns and len(left) >= 0.98 * len(known)
    before, after = ({r["doc_id"] for r in f.collect()} for f in steps["toxicity"])
    gone = before - after
    assert after <= before and np.mean([labels.get(d, 1) for d in gone]) > 0.9
    assert sum(labels.get(d) == 1 for d in gone) >= 0.8 * sum(labels.get(d) == 1 for d in before)
    texts, kept = ({r["doc_id"]: r["text"] for r in f.collect()} for f in steps["simhash_dedup"])
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    roots = plain_components(set(prints.values()))
    least = {}
    for d in sorted(prints, reverse=True):
        least[roots[prints[d]]] = d
    assert set(kept) == set(least.values())
    pieces = [r.asDict() | {"crc": r["ids_crc32"]} for r in docs.collect()]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(n < 1024 for n in check(pieces, expected(tokenizer, kept.items()))) <= 1


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
