"""Fill-in-the-middle texts against the rule written out in plain Python, with round trips."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from topshare.llm import fill_in_middle as fim
from topshare.llm.queries import op11_fill_in_middle

SPACE = " \t\n\x0b\x0c\r"


def units_of(text: str) -> list[str]:
    """Characters one by one: white space opens a unit, or closes the text."""
    units, now, seen = [], "", False
    for c in text:
        if c in SPACE and seen:
            units.append(now)
            now, seen = "", False
        now += c
        seen = seen or c not in SPACE
    return [*units, now] if now else units


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    units = units_of(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, None, text)
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return (doc_id, n, "spm", prefix, middle, suffix, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", prefix, middle, suffix, f"<P>{prefix}<S>{suffix}<M>{middle}")


TEXTS = [
    None, "", " ", "\n\t ", "one", "one two  three\r\nfour ", "  lead", "a b c 　d", "$1 \\2 \\$3 ${x}", "<P>", "x <M> y",
    "<P <S >M> <", "a\x00b \x1c c\x85d", "é 漢字 😀 🇩🇪 é end\x0b", "line\nline\nline", "< S> <p> a<", "P> <", "S><",
]


@pytest.fixture(scope="module")
def formed(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40 * len(TEXTS))]
    rows += [(None, "no id here"), (7, "twice the same"), (7, "twice the same"), (7, "another text")]
    return rows, fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))


def test_every_form(formed, rows):
    data, frame = formed
    got = rows(frame)
    assert got == sorted((plain(*r) for r in data), key=lambda r: [(v is None, str(v)) for v in r])
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_restored(formed, rows):
    data, frame = formed
    got = rows(frame.select("doc_id", fim.restore(F.col("output"), F.col("form"))))
    assert got == sorted(((d, t or "") for d, t in data), key=lambda r: [(v is None, str(v)) for v in r])


def test_shares(spark):
    frame = fim.fill_in_middle(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text")))
    counts = {r["form"]: r["count"] for r in frame.groupBy("form").count().collect()}
    assert 0.45 < (counts["psm"] + counts["spm"]) / 4000 < 0.55
    assert 0.75 < counts["spm"] / (counts["psm"] + counts["spm"]) < 0.85


def test_parameters_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a b", 5, "x")], "`my id` long, body string, n int, digest string")
    always = fim.fill_in_middle(frame, "my id", "body", seed=1, percent=100, spm_percent=0)
    assert always.columns == ["doc_id", "n", "form", "prefix", "middle", "suffix", "output"]
    (r,) = always.collect()
    assert r["form"] == "psm" and r["prefix"] + r["middle"] + r["suffix"] == "a b" and r["n"] == 2
    assert [r["form"] for r in fim.fill_in_middle(frame, "my id", "body", percent=0).collect()] == ["plain"]


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_very_long_texts(spark):
    texts = ["word " * 1_000_000, "x" * 3_000_000, " " * 2_000_000, "\n" * 500_000 + "end", "é" * 10 + " 漢" * 700_000]
    data = [(i, texts[i % 5]) for i in range(20)]
    frame = fim.fill_in_middle(spark.createDataFrame(data, "doc_id long, text string").repartition(8), percent=100)
    columns = ["doc_id", "n", "form", *[F.sha2(c, 256) for c in ("prefix", "middle", "suffix")]]
    restored = F.sha2(fim.restore(F.col("output"), F.col("form")), 256)
    got = {r[0]: tuple(r) for r in frame.select(*columns, restored).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    units = [units_of(t) for t in texts]
    for i, text in data:
        digest = sha(f"42:{i}")
        h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
        u = units[i % 5]
        a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        cut = [sha("".join(x)) for x in (u[:a], u[a:b], u[b:])]
        assert got[i] == (i, len(u), "spm" if h[3] % 100 < 80 else "psm", *cut, sha(text))


def test_whole_table_against_the_rule(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = op11_fill_in_middle(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        _, n, form, prefix, middle, _, output = plain(r["doc_id"], docs[r["doc_id"]])
        chars = [None if x is None else len(x) for x in (prefix, middle)]
        assert tuple(r) == (r["doc_id"], n, form, *chars, sha(output), sha(docs[r["doc_id"]]))


def test_plan_has_no_shuffle_and_no_python(spark):
    plan = op11_fill_in_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("regexp_replace(") == 1
