"""Helpers that several operators of this package share."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

import topshare
from topshare.session import scratch_path

#: Rows of one Arrow batch: bounds what a Python worker holds, also where texts are long.
BATCH_ROWS = 512


def prepare_workers(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the session's Arrow batches to ``rows`` (a smaller setting stays) and let Python workers import the package.

    The second holds where workers see the driver's files; a cluster gets the
    package as any other (installed, or with ``--py-files``).
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    root = str(Path(topshare.__file__).parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: Iterable) -> Iterator[str]:
    """The texts of a pandas column, null as empty."""
    return ("" if t is None or t is pd.NA or t != t else t for t in column)


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """The frame, written to the shared scratch folder and read again.

    ``options`` are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
