"""Hard negatives against brute force; bounds and trees against their definition."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topshare.llm import hard_negatives as hn
from topshare.llm.queries import op12_hard_negatives

NAN, INF = float("nan"), float("inf")


def plain(data, is_anchor, scale=256.0, positives=5, negatives=3, low=50, high=95):
    """``data``: id, label, vector; the rule without trees or blocks."""
    usable = {}
    for i, label, v in data:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(scale * x) for x in v])
        usable[i] = min(row, usable.get(i, row))
    found = []
    for a, (label, v) in usable.items():
        if not is_anchor(a):
            continue
        scores = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in usable.items() if i != a}
        first = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in first if usable[i][0] == label][:positives]:
            inside = [i for i in first if usable[i][0] != label and low * scores[p] <= 100 * scores[i] <= high * scores[p]]
            found += [(a, p, r, n, scores[p], scores[n]) for r, n in enumerate(inside[:negatives], 1)]
    return sorted(found)


def frame(spark, data, kind="double"):
    return spark.createDataFrame(data, f"vec_id long, label int, embedding array<{kind}>")


def mined(df, every=5, **options):
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % every == 0, **options).collect())


def clustered(rng, n, labels, dims=8, clusters=6):
    centres = rng.standard_normal((clusters, dims))
    points = centres[rng.integers(clusters, size=n)] + 0.2 * rng.standard_normal((n, dims))
    return [(i, int(rng.integers(labels)), [float(x) for x in points[i]]) for i in range(n)]


@pytest.mark.parametrize("labels, tree, block", [(3, 2048, 4096), (3, 7, 40), (40, 16, 64), (1, 10, 50)])
def test_against_brute_force(spark, labels, tree, block):
    data = clustered(np.random.default_rng(labels), 300, labels)
    got = mined(frame(spark, data), tree_anchors=tree, block_rows=block)
    assert got == plain(data, lambda i: i % 5 == 0)
    assert got or labels == 1


def test_ties_and_copies(spark):
    """Two thirds of the rows are one vector; scores tie, ids decide, in any blocks."""
    data = [(i, i % 4, [1.0, 0.5] if i % 3 else [0.5, 0.45 + 0.01 * (i % 5)]) for i in range(120)]
    want = plain(data, lambda i: i % 5 == 0)
    assert mined(frame(spark, data)) == want and want
    assert mined(frame(spark, data).repartition(7), tree_anchors=5, block_rows=10) == want


def test_odd_rows(spark):
    data = clustered(np.random.default_rng(5), 60, 3)
    data += [(1000, 0, None), (1005, None, data[0][2]), (1010, 1, [None] * 8), (1015, 1, [NAN] * 8), (1020, 1, [INF] + [0.0] * 7),
             (1025, 1, []), (None, 1, data[0][2]), (1030, 2, [0.0] * 8), (0, 2, data[3][2]), (5, *data[5][1:]), (5, *data[5][1:])]
    want = plain(data, lambda i: i % 5 == 0)
    short = [(2000, 1, [1.0, 2.0]), (2005, 1, [9.0])]
    assert mined(frame(spark, data + short)) == want
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(1000, 0, None), (None, None, None)])) == []
    assert mined(frame(spark, [(5, 0, [1.0]), (6, 0, [1.0])])) == []
    assert mined(frame(spark, data), every=7919) == plain(data, lambda i: i % 7919 == 0)


def test_negative_and_zero_positives(spark):
    data = [(0, 0, [1.0, 0.0]), (1, 0, [-1.0, 1.0]), (2, 0, [0.0, 1.0]), (3, 1, [0.0, -1.0]), (4, 1, [-0.7, 0.0]), (6, 1, [0.0, 0.5])]
    assert mined(frame(spark, data)) == [(0, 2, 1, 3, 0, 0), (0, 2, 2, 6, 0, 0)] == plain(data, lambda i: i % 5 == 0)


def test_large_components(spark):
    """Sums that doubles do not hold are exact too."""
    rng = np.random.default_rng(9)
    data = [(i, i % 3, [float(x) for x in rng.integers(1, 2**29, 4)]) for i in range(80)]
    want = plain(data, lambda i: i % 5 == 0, scale=1.0)
    assert mined(frame(spark, data), scale=1.0, block_rows=16) == want and max(r[4] for r in want) > 2**55


def test_other_types_and_clashing_columns(spark):
    data = [(f"k{i}", f"g{i % 2}", [1.0 + i / 10, 1.0]) for i in range(12)]
    rows = [(*d, 1, 2, 3, 4) for d in data]
    df = spark.createDataFrame(rows, "`a key` string, kind string, v array<float>, block int, id int, vector int, anchor int")
    got = hn.hard_negatives(df, F.col("a key").isin("k0", "k5"), "a key", "kind", "v")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    exact = [(k, g, [float(np.float32(x)) for x in v]) for k, g, v in data]
    assert sorted(map(tuple, got.collect())) == plain(exact, lambda i: i in ("k0", "k5"))


def test_spanning_tree():
    rng = np.random.default_rng(2)
    points = np.floor(20 * rng.standard_normal((150, 3)))
    order, parents = hn.spanning_tree(points)
    place = {n: i for i, n in enumerate(order)}
    assert sorted(order) == list(range(150)) and parents.count(-1) == 1
    assert all(place[parents[n]] < place[n] for n in order[1:])
    total = sum(np.linalg.norm(points[n] - points[parents[n]]) for n in order[1:])
    # Kruskal, as a second way to the least total.
    edges = sorted((np.linalg.norm(points[a] - points[b]), a, b) for a in range(150) for b in range(a))
    root, least = list(range(150)), 0.0
    for e, a, b in edges:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        if a != b:
            root[a], least = b, least + e
    assert math.isclose(total, least)
    assert hn.spanning_tree(np.zeros((4, 2)))[1].count(-1) == 1


def test_bounds_hold_and_spare_work():
    """Bounds enclose every true score, and in clusters most candidates are never scored again."""
    rng = np.random.default_rng(4)
    data = clustered(rng, 2000, 2, dims=16, clusters=30)
    points = np.floor(256 * np.array([v for *_, v in data]))
    anchors = points[:200]
    order, parents = hn.spanning_tree(anchors)
    place = {n: i for i, n in enumerate(order)}
    above = [place.get(parents[n], -1) for n in order]
    edges = [0.0 if parents[n] < 0 else np.linalg.norm(anchors[n] - anchors[parents[n]]) for n in order]
    scores = hn.TreeScores(anchors[order], above, edges, points)
    truth = points @ anchors[order].T

    def wanted(anchor, low, high):
        assert (low <= truth[:, anchor]).all() and (truth[:, anchor] <= high).all()
        return high >= np.partition(truth[:, anchor], -50)[-50]

    for anchor, chosen, found in scores.walk(wanted):
        assert (found == truth[chosen, anchor]).all()
    assert scores.scored < 0.5 * truth.size


def test_few_bounds_are_held_at_once():
    """A comb: along its back every anchor has a second child."""
    back = [[float(10 * i), 0.0] for i in range(60)] + [[float(10 * i), 1.0] for i in range(60)]
    order, parents = hn.spanning_tree(np.array(back))
    held, most, pending = set(), 0, {n: parents.count(n) for n in range(120)}
    for n in order:
        if parents[n] >= 0:
            pending[parents[n]] -= 1
            if not pending[parents[n]]:
                held.discard(parents[n])
        if pending[n]:
            held.add(n)
        most = max(most, len(held))
    assert most <= 8


def test_query_on_a_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    data = [(r[0], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in rows]
    ids, labels = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    points = np.floor(256 * np.array([d[2] for d in data], float)).astype(int)
    want = []
    for a in np.flatnonzero(ids % 50 == 0):
        scores = points @ points[a]
        first = [i for i in np.lexsort((ids, -scores)) if i != a]
        for p in [i for i in first if labels[i] == labels[a]][:5]:
            inside = [i for i in first if labels[i] != labels[a] and 50 * scores[p] <= 100 * scores[i] <= 95 * scores[p]]
            want += [(ids[a], ids[p], r, ids[n], scores[p], scores[n]) for r, n in enumerate(inside[:3], 1)]
    assert sorted(tuple(r) for r in op12_hard_negatives(spark, "/root/testdata/sf0.1").collect()) == sorted(want)


def test_empty_cogroups():
    tree = pa.table({"anchor_id": pa.array([], pa.int64())})
    assert hn._positives_of(tree, pa.table({}), 5).num_rows == 0
