"""Packing against the tokenizer and the rules of a packing."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from topshare.llm import packing
from topshare.llm.queries import op3_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(pieces, ids, window=1024):
    """Every id in one piece, every sequence gapless; returns the lengths of the sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert by_doc.keys() == ids.keys()
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[doc])
            assert p["crc"] == zlib.crc32(ids[doc][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids[doc])
    lengths = []
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        lengths.append(at)
    return lengths


def expected(tokenizer, docs):
    return {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in docs}


def test_whole_table(spark, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pieces = [r.asDict() | {"crc": r["ids_crc32"]} for r in op3_packing(spark, SF).collect()]
    lengths = check(pieces, expected(tokenizer, docs))
    assert sum(n < 1024 for n in lengths) <= 1


@pytest.mark.parametrize(("open_windows", "merged", "partitions"), [(2, 2, 9), (8, 32, 3), (1, 2, 5)])
def test_many_partitions_and_rounds(spark, tokenizer, open_windows, merged, partitions):
    docs = [(i, "word and more " * (i * 37 % 90)) for i in range(200)] + [(900, None), (901, ""), (902, "x" * 70_000)]
    frame = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, start int, ids int").repartition(partitions)
    found = packing.pack(frame, PATH, window=256, open_windows=open_windows, merged=merged).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in found)
    pieces = [r.asDict() | {"crc": zlib.crc32(r["ids"])} for r in found]
    lengths = check(pieces, expected(tokenizer, docs), 256)
    assert sum(n < 256 for n in lengths) <= 1


def test_best_fit_and_fullest():
    packer = packing.OnlinePacker(10, 2, 0)

    def piece(doc, n):
        return packing.Piece(doc, 0, n, n, bytes(4 * n))

    for doc, n in (("a", 7), ("b", 5), ("c", 3)):  # c fills a exactly
        packer.add(piece(doc, n))
    assert [(r[0], r[2]) for r in packer.rows] == [("a", 7), ("c", 3)]
    packer.add(piece("d", 8))
    packer.add(piece("e", 6))  # fits in neither: tops up d, the fullest, and opens a window with the rest
    assert [(r[0], r[2]) for r in packer.rows[2:]] == [("d", 8), ("e", 2)]
    assert sorted((p.doc_id, p.length) for p in packer.left()) == [("b", 5), ("e", 4)]


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    rows = [(None, "no id"), (1, "twice"), (1, "twice")]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted((r["doc_id"] is None, r["start"]) for r in found) == [(False, 0), (False, 0), (True, 0)]


def test_ids_are_those_of_the_tokenizer(tokenizer):
    encoder = packing.ByteLevelEncoder(PATH)
    texts = ["", " ", "  a  b \n c\n\nd  ", "a\x1c b\x85c", "don't <|endoftext|> x", "a　 b 　", "ﬁ ½ Ⅷ x² 漢字 🙂‍🙂 ئۇيغۇر", "﻿é́", "'s 'T"]
    texts += [f"a{chr(c)} {chr(c)}b 1{chr(c)}" for c in range(0, 0x3100, 7)]
    for text in texts:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("space", [" ", " \n", "\u3000"])
def test_very_long_runs_of_white_space(tokenizer, space):
    encoder = packing.ByteLevelEncoder(PATH)
    run = (space * 1_000_000)[:1_000_000]
    for text in (run, f"some words{run}end"):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_document_of_eight_million_ids():
    """Time grows with the length, not with its square."""
    import time

    ids = bytes(4 * 8_000_000)
    packer = packing.OnlinePacker(1024, 64, 0)
    began = time.process_time()
    packer.add(packing.Piece(1, 0, 8_000_000, 8_000_000, ids))
    assert time.process_time() - began < 3
    assert sum(r[2] for r in packer.rows) + sum(p.length for p in packer.left()) == 8_000_000
    assert all(type(r[4]) is bytes for r in packer.rows) and [len(p.ids) for p in packer.left()] == [4 * (8_000_000 % 1024)]
