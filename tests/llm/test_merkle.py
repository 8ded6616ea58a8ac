"""Merkle fingerprints against a tree built in plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from topshare.llm import merkle
from topshare.llm.queries import op10_merkle


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def pieces(text: str, end: str) -> list[str]:
    return re.split(end, text)


def plain_fingerprint(text: str) -> str:
    shown, sections = "", []
    for section in pieces(text, r"(?<=\n\n)(?=[^\n])"):
        inner, paragraphs = "", []
        for paragraph in pieces(section, r"(?<=\n)(?=[^\n])"):
            leaves = [sha(x) for x in re.findall(r"\s*(?:\S+\s*){1,5}|\s+", paragraph, re.ASCII) if x]
            paragraphs.append(sha("p" + "".join(leaves)))
            inner += ":" + paragraphs[-1][:8] + "=" + "".join(x[:8] for x in leaves)
        sections.append(sha("s" + "".join(paragraphs)))
        shown += "/" + sections[-1][:8] + inner
    return sha("r" + "".join(sections)) + shown


def plain_leaves(fingerprint: str) -> set[str]:
    joined = "".join(re.findall(r"=([0-9a-f]*)", fingerprint))
    return {joined[i : i + 8] for i in range(0, len(joined), 8)}


def plain_likeness(a: str, b: str) -> float:
    if a[:64] == b[:64]:
        return 1.0
    x, y = plain_leaves(a), plain_leaves(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def expected(docs: list[tuple[int, str]]) -> dict:
    ring = sorted(docs, key=lambda d: -d[0])
    result = {}
    for here, after in zip(ring, ring[1:] + ring[:1]):
        text = here[1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + (after[1] or "")[:third]
        a, b, c = (plain_fingerprint(t) for t in (text, edited, after[1] or ""))
        result[here[0]] = (len(text), sha(edited), a, b, plain_likeness(a, b), plain_likeness(a, c))
    return result


CASES = [
    (1, "One two three four five six seven.\nA second paragraph.\n\nA new section é ü 漢字."),
    (2, None),
    (3, ""),
    (4, "  spaced \t out\r\n\n\n\nlast"),
    (7, "same text"),
    (9, "same text"),
    (12, "word " * 3000),
    (20, "x"),
    (21, "\n"),
    (22, "🙂🙂🙂🙂🙂🙂 many\nlines\nhere"),
]


def as_rows(frame):
    return {r["doc_id"]: tuple(r)[1:] for r in frame.collect()}


def test_cases_against_plain_tree(spark):
    docs = spark.createDataFrame([(*c, "other", 1) for c in CASES], "doc_id long, text string, digest string, range int")
    got = as_rows(merkle.fingerprint_edits(docs))
    want = expected(CASES)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key]) if isinstance(want[key], float) else got[key] == want[key]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert as_rows(op10_merkle(spark, sf)) == expected(docs)


def test_one_document_follows_itself(spark):
    docs = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    row = merkle.fingerprint_edits(docs).first()
    assert row["edited_sha256"] == sha("abcdab") and row["near_next"] == 1.0


def test_repeated_rows_and_null_ids(spark):
    rows = [(2, "b b b"), (2, "b b b"), (2, "another"), (None, "no id"), (None, None), (1, "a a a")]
    got = merkle.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    same = [tuple(r) for r in got if r["doc_id"] == 2 and r["n_chars"] == 5]
    assert len(same) == 2 and same[0] == same[1]


def test_empty_table(spark):
    assert merkle.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_edits_are_located(spark):
    before = "a b c\nd e f\n\ng h i\nj k l\n"
    after = "a b c\nd e f\n\ng h i\nj K l\n"
    frame = spark.createDataFrame([(before, after), (before, before), (before, before + "\n\nmore")], "x string, y string")
    found = frame.select(merkle.edited_paragraphs(merkle.fingerprint(F.col("x")), merkle.fingerprint(F.col("y")))).collect()
    assert [[tuple(p) for p in r[0]] for r in found[:2]] == [[(1, 1)], []]
    assert (2, 0) in [tuple(p) for p in found[2][0]]
