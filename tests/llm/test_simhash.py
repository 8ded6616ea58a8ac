"""SimHash near-duplicates against brute force."""

from collections import Counter

import numpy as np
import pytest
import xxhash

from topshare.llm import simhash
from topshare.llm.components import connected_components
from topshare.llm.queries import op6_simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, list int, key string, fingerprint string"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\v\f\r", "     "))
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = Counter()
    for shingle in shingles:
        h = xxhash.xxh64_intdigest(shingle.encode(), seed=42)
        votes.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def plain_components(values):
    """From each value to the least one reachable."""
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    ordered = sorted(values)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def expected(docs):
    prints = {d: plain_fingerprint(t) for d, t in docs}
    roots = plain_components(set(prints.values()))
    least = {}
    for d, p in prints.items():
        least[roots[p]] = min(d, least.get(roots[p], d))
    return {(d, f"{p:016x}", least[roots[p]]) for d, p in prints.items()}


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {tuple(r) for r in op6_simhash(spark, SF).collect()} == expected(docs)


def test_cases(spark):
    docs = [(5, None), (4, ""), (3, " \n\t"), (9, "One two"), (8, "one TWO"), (10, "É x y z"), (11, "é x y z"), (20, "a b c " * 30_000)]
    rows = [(*d, 1, "k", "f") for d in docs] + [(9, "One two", 1, "k", "f")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    found = {(r["doc_id"], f"{r['fingerprint'] & (1 << 64) - 1:016x}", r["component_id"]) for r in got}
    assert found == expected(docs)
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 4, 5)} == {3}


def test_empty_table_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "alone with its kind of words"), (None, "x y z"), (7, "x y z")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["component_id"] or 0 for r in got) == [0, 7, 7]


def clusters():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    values = [base]
    for flips in (1, 2, 3, 4):
        some = rng.choice(base, 60)
        for _ in range(flips):
            some = some ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
        values.append(some)
    crowd = np.full(300, base[0])
    for _ in range(2):
        crowd = crowd ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    return np.unique(np.concatenate([*values, crowd])).view(np.int64).tolist()


@pytest.mark.parametrize(("paired", "listed"), [(256, 65_536), (4, 65_536), (8, 20)])
def test_links_of_short_long_and_relisted_lists(spark, paired, listed):
    values = clusters()
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    found = {r["node"]: r["root"] for r in connected_components(simhash.links(frame, paired, listed)).collect()}
    assert {v: found.get(v, v) for v in values} == plain_components(values)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(3, 3), (700, 699), (500, 501)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert found == {i: 100 for i in range(101, 161)} | {i: 500 for i in range(501, 701)}


def test_one_of_each_stays(spark):
    rows = [(1, "a b c d", "en"), (2, "a b c d", "de"), (3, "other words in here", None), (3, "other words in here", None)]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted((r["doc_id"], r["lang"]) for r in kept.collect()) == [(1, "en"), (3, None)]


def test_unique_texts_stay_where_ids_repeat(spark):
    one, other, third = "one text of some words here", "quite another text with its own words", "and a third that is not like them"
    schema = "doc_id long, text string, lang string, `__digest2` string"

    def kept(rows):
        found = []
        for n in (1, 3, 7):
            frame = spark.createDataFrame([(*r, "x") for r in rows], schema).repartition(n)
            found.append(sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in simhash.keep_one_of_each(frame).collect()))
        assert found[0] == found[1] == found[2]
        return [r[1:] for r in found[0]]

    assert kept([(5, one, "a"), (5, other, "b")]) == sorted([(5, one), (5, other)])
    assert kept([(1, one, "a"), (2, other, "b"), (2, one, "c"), (1, third, "d")]) == sorted([(1, one), (2, other), (1, third)])
    assert kept([(None, one, "a"), (None, one, "b"), (None, other, "c"), (4, other, "d"), (9, "", "e"), (8, None, "f")]) == [
        (4, other), (8, None), (None, one)]
    assert len(kept([(3, one, "a")] * 40 + [(3, other, "a")] * 40)) == 2


def test_the_row_that_stays_of_equal_ids_and_texts(spark):
    rows = [(1, "a b c d", lang) for lang in ("en", "de", "fr", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    stays = {tuple(simhash.keep_one_of_each(frame.repartition(n)).collect()) for n in (1, 2, 4)}
    assert len(stays) == 1 and len(stays.pop()) == 1
