"""The permutation index: distances against their definition, recall against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topshare.llm import permutation_index as index
from topshare.llm.queries import op13_permutation_index

NAN, INF = float("nan"), float("inf")


def exact(data, is_query, count=20):
    ids = np.array([d[0] for d in data])
    points = np.array([d[1] for d in data], float)
    found = {}
    for q in np.flatnonzero([is_query(i) for i in ids]):
        scores = (points * points[q]).sum(axis=1)
        found[ids[q]] = [(ids[i], scores[i]) for i in np.lexsort((ids, -scores)) if i != q][:count]
    return found


def searched(df, every=4, **options):
    found = {}
    for r in sorted(index.nearest_neighbours(df, F.col("vec_id") % every == 0, **options).collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def same(got, want):
    return {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()} and all(
        np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12, atol=1e-12) for q in want
    )


def frame(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_and_scores(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    want = exact([(r["vec_id"], r["embedding"]) for r in rows], lambda i: i % 20 == 0)
    points = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    got = {}
    for r in op13_permutation_index(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    shares = []
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert all(abs(s - points[q] @ points[i]) < 1e-12 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        shares.append(len({f[1] for f in found} & {i for i, _ in want[q]}) / 20)
    assert np.mean(shares) >= 0.9


def test_footrule_distance():
    rng = np.random.default_rng(1)
    permutations = np.array([rng.permutation(12)[:5] for _ in range(30)]).astype("<u2")
    files = index.InvertedFiles(permutations, 12)
    for asked in permutations[:10]:
        place = lambda p, perm: list(perm).index(p) if p in perm else 5
        want = [sum(abs(place(p, asked) - place(p, row)) for p in {*asked, *row}) for row in permutations]
        assert files.distances(asked).tolist() == want


def test_small_blocks_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(index, "QUERY_ROWS", 16)
    rng = np.random.default_rng(3)
    data = [(i, rng.standard_normal(6).tolist()) for i in range(400)]
    want = exact(data, lambda i: i % 4 == 0, 5)
    got = searched(frame(spark, data), count=5, block_rows=64, reranked_rows=20, reranked_share=0.3)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) > 0.9


def test_everything_scored_is_exact(spark):
    """With a share of one every row is scored: copies tie, ids decide."""
    rng = np.random.default_rng(4)
    copies = rng.standard_normal(4).tolist()
    data = [(i, copies if i % 3 == 0 else rng.standard_normal(4).tolist()) for i in range(200)]
    want = exact(data, lambda i: i % 4 == 0, 20)
    assert same(searched(frame(spark, data).repartition(5), reranked_share=1.0, block_rows=50), want)


def test_a_hot_vector_is_found_whole(spark):
    """Copies are as near as each other, so none is cut off by the share that is scored."""
    rng = np.random.default_rng(8)
    hot = rng.standard_normal(8)
    data = [(i, (hot if i % 2 else rng.standard_normal(8)).tolist()) for i in range(1, 600)]
    got = searched(frame(spark, [*data, (4000, (hot + 0.01).tolist())]), every=4000, reranked_rows=20, reranked_share=0.01)
    near = [i for i, _ in got[4000] if i % 2]
    assert near == list(range(1, 2 * len(near), 2)) and len(near) >= 15


def test_norms_of_all_sizes(spark):
    rng = np.random.default_rng(6)
    data = [(i, (rng.standard_normal(8) * 10.0 ** rng.integers(-150, 150)).tolist()) for i in range(300)]
    want, got = exact(data, lambda i: i % 4 == 0), searched(frame(spark, data))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) > 0.9


def test_odd_rows(spark):
    data = [(i, [1.0, float(i)]) for i in range(10)]
    odd = [(100, None), (104, []), (108, [0.0, 0.0]), (112, [NAN, 1.0]), (116, [INF, 1.0]), (120, [None, 1.0]), (None, [1.0, 1.0]),
           (124, [1.0]), (8, [1.0, 8.0]), (8, [1.0, 9.5])]
    assert same(searched(frame(spark, data + odd)), exact(data, lambda i: i % 4 == 0))
    assert searched(frame(spark, [])) == {} == searched(frame(spark, odd[:3]))
    assert searched(frame(spark, [(4, [1.0])])) == {}
    assert searched(frame(spark, data), every=97, count=3) == {0: [(1, 1.0), (2, 1.0), (3, 1.0)]}
    assert searched(frame(spark, [(1, [1.0]), (2, [2.0])])) == {}


def test_other_types_and_clashing_columns(spark):
    data = [(f"k{i}", [float(i), 1.0], i, "x", 1, 2) for i in range(9)]
    df = spark.createDataFrame(data, "`a key` string, v array<float>, id int, vector string, band int, block int")
    found = index.nearest_neighbours(df, F.col("id") == 3, "a key", "v", 2)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [("k3", 1, "k8", 25.0), ("k3", 2, "k7", 22.0)]
