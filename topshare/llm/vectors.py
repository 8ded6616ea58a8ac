"""Vectors of a table as binary columns, one row for each id, for operators that work on matrices."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topshare.llm.common import prepare_workers, written

#: Rows of one Arrow batch.
BATCH_ROWS = 2048


def usable_vectors(
    df: DataFrame,
    id_column: str,
    vector_column: str,
    others: Mapping[str, Column],
    scale: float | None = None,
    with_zero: bool = True,
) -> DataFrame:
    """``id``, the columns of ``others``, ``vector`` (little-endian doubles); this starts jobs.

    Left out are rows whose id or any of ``others`` is null, whose vector is
    null, empty or holds null, NaN or an infinity, or is zero unless
    ``with_zero``, and rows whose vector has another length than most vectors
    have (of two such lengths the lesser counts).  ``scale`` turns each
    component ``x`` into ``floor(scale * x)``.

    An id that occurs more than once counts once: the row with the least
    ``others`` and vector stands for it.
    """
    spark = df.sparkSession
    prepare_workers(spark, BATCH_ROWS)
    chosen = df.select(
        F.col(f"`{id_column}`").alias("id"), *[c.alias(n) for n, c in others.items()], F.col(f"`{vector_column}`").alias("vector")
    ).dropna()
    kept = [f for f in chosen.schema if f.name != "vector"]
    schema = T.StructType([*kept, T.StructField("vector", T.BinaryType()), T.StructField("dim", T.IntegerType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            if scale is not None:
                with np.errstate(over="ignore", invalid="ignore"):
                    values = np.floor(scale * values)
            ends = np.cumsum(sizes)
            unusable, set_ = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(values), values != 0))
            good = (sizes > 0) & (unusable[ends] == unusable[ends - sizes])
            if not with_zero:
                good &= set_[ends] > set_[ends - sizes]
            raw = np.ascontiguousarray(values, "<f8").tobytes()
            found = [raw[8 * (e - n) : 8 * e] for e, n in zip(ends[good], sizes[good])]
            rest = batch.drop_columns(["vector"]).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(found, pa.binary()), pa.array(sizes[good], pa.int32())],
                names=[*rest.schema.names, "vector", "dim"],
            )

    rows = chosen.mapInArrow(read, schema)
    names = [*others, "vector", "dim"]
    # Partial minima come before the shuffle, so an id that repeats very often is a row for each task.
    one = rows.groupBy("id").agg(F.min(F.struct(*names)).alias("row")).select("id", *[F.col(f"row.{n}").alias(n) for n in names])
    one = written(one, "vectors")
    usual = one.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    return one.where(F.col("dim") == (usual["dim"] if usual else 0)).drop("dim")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a binary column as rows."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)

