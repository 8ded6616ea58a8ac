"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A session with the settings the results depend on (UTC) and AQE on.

    On a cluster leave ``master`` unset and let spark-submit decide.
    """
    builder = (
        SparkSession.builder.appName("topshare")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # HotSpot does not compile larger methods; Spark then splits the generated code instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Call sites of every column expression cost a round trip each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master (one process) may go without it; there a temporary
    folder is set.  On a cluster a machine-local folder would be lost with its
    executor, so a missing setting is an error, and a ``file:`` folder has to be
    a mount that all machines share.  Tables stay there until they are released,
    one by one or with :func:`release_session`.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="topshare-"))
    return sc.getCheckpointDir()


def _session_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_session_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the scratch folder and read it back.

    Cuts the lineage: a lost executor re-reads the table instead of running
    the upstream plan again.  Returns the frame and its path.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`materialize`."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_session(spark: SparkSession) -> None:
    """Delete every scratch table of this application; frames that read one cannot be used afterwards."""
    release(spark, _session_folder(spark))
