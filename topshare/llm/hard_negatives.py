"""Hard negatives, mined with score bounds along spanning trees of the anchors.

Anchors that lie close are dealt into blocks of bounded size, and the anchors
of a block are linked by a minimum spanning tree.  Scores at the root are
computed for all candidates.  From a parent to its child the score of a
candidate changes by at most the length of the edge times the norm of the
candidate, so bounds at the parent, widened by that, hold at the child; only
candidates whose bounds reach into what is looked for there are scored again
(and have exact bounds from then on).  Anchor blocks meet all rows block by
block, first for the positives, which give the windows, then for the negatives.

Scores are inner products of whole numbers and exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topshare.llm.common import written
from topshare.llm.vectors import matrix, usable_vectors
from topshare.operators.numbering import number_rows

#: Anchors of one tree.
TREE_ANCHORS = 2048
BLOCK_ROWS = 4096
_SIGNS = 24
#: Doubles hold whole numbers up to here exactly; scores are compared at up to 100 times their size.
_EXACT = 2.0**53 / 100


def _sign_codes(rows: DataFrame) -> DataFrame:
    """``code``: on which sides of fixed random hyperplanes a vector lies, so that close vectors often share its head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("vector"))
            planes = np.random.default_rng(1).standard_normal((vectors.shape[1], _SIGNS))
            codes = ((vectors @ planes) > 0) @ (1 << np.arange(_SIGNS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(codes, pa.int64())], names=["id", "label", "code"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code bigint")


def spanning_tree(vectors: np.ndarray) -> tuple[list[int], list[int]]:
    """A minimum spanning tree of the rows as an order and the parent of each row (-1 for the root).

    Parents come before their children, and among the children the one with the
    largest subtree comes last: a walk in that order has to keep what it knows
    of a logarithmic number of parents only.
    """
    n = len(vectors)
    squares = (vectors**2).sum(axis=1)
    nearest, parent = np.full(n, np.inf), np.full(n, -1)
    outside, joined, now = np.ones(n, bool), [], 0
    for _ in range(n):
        outside[now] = False
        joined.append(now)
        distance = squares + squares[now] - 2 * (vectors @ vectors[now])
        closer = outside & (distance < nearest)
        nearest[closer], parent[closer] = distance[closer], now
        now = int(np.argmin(np.where(outside, nearest, np.inf)))
    size = np.ones(n, np.int64)
    children: list[list[int]] = [[] for _ in range(n)]
    for child in reversed(joined[1:]):
        size[parent[child]] += size[child]
        children[parent[child]].append(child)
    order, stack = [], joined[:1]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += sorted(children[node], key=lambda c: -size[c])
    return order, parent.tolist()


def _trees(anchors: DataFrame) -> DataFrame:
    """``block, place, parent, edge`` of each anchor: its place in the tree, that of its parent, and the distance to it."""

    def run(table: pa.Table) -> pa.Table:
        vectors = matrix(table.column("vector"))
        order, parents = spanning_tree(vectors)
        place = {node: i for i, node in enumerate(order)}
        above = [place.get(parents[node], -1) for node in order]
        edges = [0.0 if parents[n] < 0 else float(np.linalg.norm(vectors[n] - vectors[parents[n]])) for n in order]
        return table.select(["block", "id", "label", "vector"]).take(pa.array(order)).append_column(
            "place", pa.array(range(len(order)), pa.int32())
        ).append_column("parent", pa.array(above, pa.int32())).append_column("edge", pa.array(edges, pa.float64()))

    kinds = {f.name: f.dataType.simpleString() for f in anchors.schema}
    return anchors.groupBy("block").applyInArrow(
        run,
        f"block bigint, id {kinds['id']}, label {kinds['label']}, vector binary, place int, parent int, edge double",
    )


class TreeScores:
    """The scores of one block of candidates at the anchors of one tree.

    :attr:`scored` counts the pairs whose score was computed.
    """

    def __init__(self, anchors: np.ndarray, parents: list[int], edges: list[float], candidates: np.ndarray):
        largest = max(np.abs(anchors).max(), np.abs(candidates).max())
        exact = float(largest) ** 2 * anchors.shape[1] < _EXACT
        self._norms = np.sqrt((candidates**2).sum(axis=1))
        self._lengths = np.sqrt((anchors**2).sum(axis=1))
        # Larger scores are whole numbers of any size.
        whole = np.frompyfunc(int, 1, 1)
        self._anchors, self._candidates = (anchors, candidates) if exact else (whole(anchors), whole(candidates))
        self._parents, self._edges = parents, edges
        self._children = np.bincount(np.array([p for p in parents if p >= 0], np.int64), minlength=len(parents))
        self.scored = 0

    def walk(self, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor in order the candidates that are scored, and their scores.

        ``wanted(anchor, low, high)`` tells by the bounds which candidates count;
        at the root all are scored.
        """
        everyone = np.arange(len(self._norms))
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        pending = self._children.copy()
        for anchor, parent in enumerate(self._parents):
            if parent < 0:
                low, high = np.full(len(everyone), -np.inf), np.full(len(everyone), np.inf)
                chosen = everyone
            else:
                # A little more than the bound covers what doubles round.
                reach = self._edges[anchor] * self._norms * (1 + 1e-9) + 1 + 1e-12 * self._lengths[parent] * self._norms
                low, high = bounds[parent][0] - reach, bounds[parent][1] + reach
                pending[parent] -= 1
                if not pending[parent]:
                    del bounds[parent]
                chosen = np.flatnonzero(wanted(anchor, low, high))
            scores = (self._candidates if len(chosen) == len(everyone) else self._candidates[chosen]) @ self._anchors[anchor]
            self.scored += len(chosen)
            if pending[anchor]:
                low[chosen] = high[chosen] = scores.astype(float)
                bounds[anchor] = low, high
            yield anchor, chosen, scores


def _largest(values: np.ndarray, count: int) -> float:
    """The ``count``-th largest value, minus infinity if there are fewer."""
    return np.partition(values, len(values) - count)[len(values) - count] if len(values) >= count else -np.inf


class _Block:
    """Columns of a cogroup: the anchors of a tree and a block of candidates."""

    def __init__(self, tree: pa.Table, rows: pa.Table):
        tree = tree.sort_by("place")
        self.anchors = tree.column("anchor_id").to_pylist()
        self.id_type = tree.schema.field("anchor_id").type
        self.windows = tree.column("positives").to_pylist() if "positives" in tree.schema.names else []
        self.ids = rows.column("id").to_numpy()
        self.in_order = np.empty(len(self.ids), np.int64)
        self.in_order[np.argsort(self.ids, kind="stable")] = np.arange(len(self.ids))
        # Labels of any type as numbers; those of candidates that no anchor has are -1.
        known = {label: n for n, label in enumerate(dict.fromkeys(tree.column("anchor_label").to_pylist()))}
        self.anchor_labels = [known[label] for label in tree.column("anchor_label").to_pylist()]
        self.labels = np.array([known.get(label, -1) for label in rows.column("label").to_pylist()])
        self.scores = TreeScores(
            matrix(tree.column("anchor_vector")),
            tree.column("parent").to_pylist(),
            tree.column("edge").to_pylist(),
            matrix(rows.column("vector")),
        )

    def first(self, chosen: np.ndarray, scores: np.ndarray, count: int) -> list[tuple[object, int]]:
        """The best of ``chosen``, equal scores in order of id."""
        if len(chosen) > count:
            enough = scores >= np.partition(scores, len(scores) - count)[len(scores) - count]
            chosen, scores = chosen[enough], scores[enough]
        best = sorted(range(len(chosen)), key=lambda i: (-scores[i], self.in_order[chosen[i]]))[:count]
        return [(self.ids[chosen[i]], int(scores[i])) for i in best]


def _positives_of(tree: pa.Table, rows: pa.Table, count: int) -> pa.Table:
    found: list[tuple] = []
    if tree.num_rows and rows.num_rows:
        block = _Block(tree, rows)

        def same(anchor: int) -> np.ndarray:
            return (block.labels == block.anchor_labels[anchor]) & (block.ids != block.anchors[anchor])

        def wanted(anchor: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            alike = same(anchor)
            return alike & (high >= _largest(low[alike], count))

        for anchor, chosen, scores in block.scores.walk(wanted):
            alike = same(anchor)[chosen]
            found += [(block.anchors[anchor], *f) for f in block.first(chosen[alike], scores[alike], count)]
    return _table(found, tree, ["anchor_id", "positive_id"], ["positive_score"])


def _negatives_of(tree: pa.Table, rows: pa.Table, count: int, low_percent: int, high_percent: int) -> pa.Table:
    found: list[tuple] = []
    if tree.num_rows and rows.num_rows:
        block = _Block(tree, rows)

        def wanted(anchor: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            other = block.labels != block.anchor_labels[anchor]
            any_window = np.zeros(len(other), bool)
            for score in {p["positive_score"] for p in block.windows[anchor] or []}:
                bottom, top = low_percent * score / 100, high_percent * score / 100
                slack = 1e-9 * abs(score) + 1e-9
                near = other & (high >= bottom - slack) & (low <= top + slack)
                # With enough candidates surely inside, none that stays below them can be among the first.
                inside = near & (low >= bottom + slack) & (high <= top - slack)
                any_window |= near & (high >= _largest(low[inside], count))
            return any_window

        for anchor, chosen, scores in block.scores.walk(wanted):
            other = block.labels[chosen] != block.anchor_labels[anchor]
            chosen, scores = chosen[other], scores[other]
            for positive in block.windows[anchor] or []:
                score = positive["positive_score"]
                inside = (low_percent * score <= 100 * scores) & (100 * scores <= high_percent * score)
                inside = inside.astype(bool)
                for negative, value in block.first(chosen[inside], scores[inside], count):
                    found.append((block.anchors[anchor], positive["positive_id"], negative, score, value))
    return _table(found, tree, ["anchor_id", "positive_id", "negative_id"], ["positive_score", "negative_score"])


def _table(found: list[tuple], tree: pa.Table, ids: list[str], numbers: list[str]) -> pa.Table:
    id_type = tree.schema.field("anchor_id").type if "anchor_id" in tree.schema.names else pa.int64()
    columns = list(zip(*found)) or [()] * (len(ids) + len(numbers))
    types = [id_type] * len(ids) + [pa.int64()] * len(numbers)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=[*ids, *numbers])


def hard_negatives(
    df: DataFrame,
    anchors: Column,
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "embedding",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    tree_anchors: int = TREE_ANCHORS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` (this starts jobs).

    A score is the inner product of the components ``floor(scale * x)``; higher
    ones come first, equal ones in order of id.  Anchors are the rows that meet
    ``anchors``.  For each anchor and each of its first ``positives`` other rows
    of the same label these are the first ``negatives`` rows of another label
    whose score is ``low_percent`` to ``high_percent`` of the positive's score,
    both included; all of them, if fewer.  So a positive below zero has none.

    Rows whose id, label or vector is null, whose vector is empty or holds null
    or non-finite components, or has another length than most vectors, take no
    part; zero vectors do.  An id that repeats counts once, with its least label
    and vector.  An empty table gives no rows.  Other columns are not looked at,
    whatever their names.  A returned score that does not fit 64 bits is an error.

    Every candidate meets every tree, in blocks of ``block_rows`` rows dealt by a
    hash of the id and trees of ``tree_anchors`` anchors, so a label or a group
    of copies that holds a third of all rows is spread like any other.
    """
    others = {"label": F.col(f"`{label_column}`"), "anchor": F.coalesce(anchors, F.lit(False))}
    rows = usable_vectors(df, id_column, vector_column, others, scale)
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors")).first()
    blocks = max(1, -(-counts["rows"] // block_rows))
    trees = max(1, -(-counts["anchors"] // tree_anchors))

    # Anchors of one label and close ones stand together.
    codes = _sign_codes(rows.where("anchor").select("id", "label", "vector"))
    order = [F.asc("label"), F.asc("code"), F.asc("id")]
    numbered = number_rows(codes.select("id", "label", "code"), order, max_window_rows=20_000)
    placed = numbered.select("id", F.floor((F.col("row_no") - 1) / tree_anchors).alias("block"))
    tree = written(_trees(rows.select("id", "label", "vector").join(placed, "id")), "trees").select(
        "block",
        F.col("id").alias("anchor_id"),
        F.col("label").alias("anchor_label"),
        F.col("vector").alias("anchor_vector"),
        "place",
        "parent",
        "edge",
    )
    all_chunks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("chunk")
    chunk = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("chunk")
    candidates = rows.select("id", "label", "vector", chunk)
    kind = rows.schema["id"].dataType.simpleString()

    # A tree needs the rows of its own labels for its positives.
    labels = tree.select(F.col("block").alias("tree"), F.col("anchor_label").alias("label")).distinct()
    alike = candidates.join(labels, "label")
    met = tree.select("*", all_chunks).groupBy("block", "chunk").cogroup(alike.groupBy("tree", "chunk"))
    near = met.applyInArrow(
        lambda t, r: _positives_of(t, r, positives), f"anchor_id {kind}, positive_id {kind}, positive_score bigint"
    )
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = written(near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives), "positives")

    # And all rows for its negatives; at most ``positives`` windows for an anchor.
    windows = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    aimed = written(tree.join(windows, "anchor_id", "left"), "windows").select("*", all_chunks)
    spread = candidates.select(
        "id", "label", "vector", "chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(trees - 1).cast("bigint"))).alias("tree")
    )
    met = aimed.groupBy("block", "chunk").cogroup(spread.groupBy("tree", "chunk"))
    found = met.applyInArrow(
        lambda t, r: _negatives_of(t, r, negatives, low_percent, high_percent),
        f"anchor_id {kind}, positive_id {kind}, negative_id {kind}, positive_score bigint, negative_score bigint",
    )
    order_of = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order_of)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
