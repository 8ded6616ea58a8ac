"""Approximate nearest neighbours by a permutation index.

Every vector is told by the order of its nearest pivots: the places of the first
``PLACES`` of ``PIVOTS`` pivots.  Rows are dealt into blocks of bounded size, and
each block posts its rows in inverted files, one for each pivot.  A query reads
the files of its own nearest pivots, which gives the footrule distance between
its permutation and those of all rows of the block: a pivot that only one of
both has counts as if it came after the last place of the other.  The nearest
by that distance are scored with the original vectors.

A permutation tells the direction of a vector only.  So rows are dealt by bands
of their norms (a factor of 1.19), in which the nearest direction has about the
largest inner product, and the blocks of each band are ranked for themselves:
long vectors don't hide the others, nor short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topshare.llm.common import written
from topshare.llm.vectors import matrix, usable_vectors

#: Pivots, at most: the different vectors of the table with the least hashes, all of them if there are no more.
PIVOTS = 512
#: Nearest pivots that a permutation keeps.
PLACES = 64
#: Rows of a block that are scored: so many, and this share of the block.
RERANKED_ROWS = 160
RERANKED_SHARE = 0.12
BLOCK_ROWS = 8192
QUERY_ROWS = 1024


def _directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the band of each norm: ``2 ** (band / 4)`` within an eighth of a power of two."""
    largest = np.abs(vectors).max(axis=1)[:, None]
    scaled = vectors / largest
    norms = np.sqrt((scaled**2).sum(axis=1))[:, None]
    bands = np.floor(4 * (np.log2(largest) + np.log2(norms)) + 0.5)
    return scaled / norms, bands[:, 0].astype(np.int32)


def _pivots(rows: DataFrame, count: int) -> np.ndarray:
    """The at most ``count`` different vectors with the least hashes, as unit vectors (this starts jobs)."""
    hashed = rows.select("vector", F.xxhash64("vector").alias("hash"))
    # Only hashes are shuffled, each once for a task, so copies weigh nothing.
    chosen = [r["hash"] for r in hashed.select("hash").distinct().orderBy("hash").limit(count).collect()]
    if not chosen:
        return np.empty((0, 1))
    found = hashed.where(F.col("hash").isin(chosen)).groupBy("hash").agg(F.min("vector").alias("vector"))
    vectors = np.frombuffer(b"".join(bytes(r["vector"]) for r in found.orderBy("hash").collect()), "<f8")
    return _directions(vectors.reshape(len(chosen), -1))[0]


def _permutations(rows: DataFrame, pivots: np.ndarray, places: int) -> DataFrame:
    """``band`` and ``permutation`` of each row: its first pivots, nearest first, as little-endian 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units, bands = _directions(matrix(batch.column("vector")))
            order = np.argsort(-(units @ pivots.T), axis=1, kind="stable")[:, :places].astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bands, pa.int32()), pa.array([row.tobytes() for row in order], pa.binary())],
                names=[*batch.schema.names, "band", "permutation"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, query boolean, vector binary, band int, permutation binary")


class InvertedFiles:
    """The rows of one block, posted under each of their nearest pivots."""

    def __init__(self, permutations: np.ndarray, pivots: int):
        self._rows, self._places = permutations.shape
        posted = permutations.ravel()
        order = np.argsort(posted, kind="stable")
        self._row, self._place = order // self._places, order % self._places
        self._starts = np.searchsorted(posted[order], np.arange(pivots + 1))

    def distances(self, permutation: np.ndarray) -> np.ndarray:
        """The footrule distance of every row.

        Over all pivots of both that is ``places * (places + 1)`` less twice the
        sum, over the shared ones, of the places behind the later of both.
        """
        shared = np.zeros(self._rows, np.int64)
        for place, pivot in enumerate(permutation):
            file = slice(self._starts[pivot], self._starts[pivot + 1])
            shared[self._row[file]] += self._places - np.maximum(self._place[file], place)
        return self._places * (self._places + 1) - 2 * shared


def nearest_neighbours(
    df: DataFrame,
    queries: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    count: int = 20,
    pivots: int = PIVOTS,
    places: int = PLACES,
    reranked_rows: int = RERANKED_ROWS,
    reranked_share: float = RERANKED_SHARE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that meets ``queries`` the rows of largest inner product found.

    Scores are double-precision inner products of the original vectors, the
    largest come first, equal ones in order of id.  The row itself is left out.
    Of each block ``reranked_rows`` rows and ``reranked_share`` of them, at least,
    are scored, and all that are as near as the last of these.  A query with
    fewer than ``count`` other rows gets all of them.  (This starts jobs.)

    Ids and vectors that are null, vectors that are empty, zero or hold null or
    non-finite components, and those of another length than most take no part;
    an id that repeats counts once, with its least vector.  An empty table gives
    no rows.  Other columns are not looked at, whatever their names.

    Collected are at most ``pivots`` vectors and a row for each band of norms (a
    double has some eight thousand).  Queries meet all rows block by block; rows
    are dealt by a hash of the id, so copies of one vector spread.
    """
    rows = usable_vectors(df, id_column, vector_column, {"query": F.coalesce(queries, F.lit(False))}, with_zero=False)
    rows = rows.select("id", "query", "vector")
    chosen = _pivots(rows, pivots)
    placed = min(places, len(chosen))
    indexed = written(_permutations(rows, chosen, placed), "permutations")
    sizes = indexed.groupBy("band").agg(F.count(F.lit(1)).alias("rows"), F.count_if("query").alias("asked")).orderBy("band").collect()

    # Blocks are numbered over all bands.
    first, numbered = 0, []
    for size in sizes:
        blocks = -(-size["rows"] // block_rows)
        numbered.append((size["band"], first, blocks))
        first += blocks
    spark = df.sparkSession
    bands = F.broadcast(spark.createDataFrame(numbered, "band int, first int, blocks int"))
    parts = max(1, -(-sum(s["asked"] for s in sizes) // QUERY_ROWS))
    block = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int")
    dealt = indexed.join(bands, "band").select(
        "id", "vector", "permutation", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    )
    asked = indexed.where("query").select(
        F.col("id").alias("query_id"),
        F.col("vector").alias("query_vector"),
        F.col("permutation").alias("query_permutation"),
        F.explode(F.sequence(F.lit(0), F.lit(max(first, 1) - 1))).alias("block"),
        F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    n_pivots = len(chosen)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids = right.column("id").to_numpy()
            vectors = matrix(right.column("vector"))
            in_order = np.empty(len(ids), np.int64)
            in_order[np.argsort(ids, kind="stable")] = np.arange(len(ids))
            files = InvertedFiles(_read_permutations(right.column("permutation")), n_pivots)
            most = min(len(ids), max(count + 1, reranked_rows + int(np.ceil(reranked_share * len(ids)))))
            permutations = _read_permutations(left.column("query_permutation"))
            for query, vector, permutation in zip(left.column("query_id").to_pylist(), matrix(left.column("query_vector")), permutations):
                distances = files.distances(permutation)
                near = np.flatnonzero(distances <= np.partition(distances, most - 1)[most - 1])
                near = near[ids[near] != query]
                # Row by row, so that equal vectors have equal scores in every block.
                scores = (vectors[near] * vector).sum(axis=1)
                best = np.lexsort((in_order[near], -scores))[:count]
                found += [(query, ids[near[b]], scores[b]) for b in best]
        columns = list(zip(*found)) or [(), (), ()]
        id_type = right.schema.field("id").type
        return pa.table(
            [pa.array(columns[0], id_type), pa.array(columns[1], id_type), pa.array(columns[2], pa.float64())],
            names=["query_id", "vec_id", "score"],
        )

    met = asked.groupBy("part", "block").cogroup(dealt.groupBy("part", "block"))
    scored = met.applyInArrow(search, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _read_permutations(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u2").reshape(len(rows), -1)
