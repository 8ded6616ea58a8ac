"""Digests of files of any size: whole, and as a tree over blocks.

Tasks read a file in pieces, so a worker never holds more than one piece.  The
SHA-256 of a whole file has to be computed from its start to its end, by one
task; blocks of one file are hashed by as many tasks as there are, and a tree of
digests over them tells whether two files differ, and where.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a task holds of a file at once.
PIECE_BYTES = 4 << 20
BLOCK_BYTES = 64 << 20
#: Digests that one node of the tree joins.
FAN_OUT = 1024
#: Spark's binary reader holds a file in one row, of at most so many bytes.
_WHOLE_BYTES = 2**31 - 1


def list_files(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """path, length of every file below ``path`` that is not empty (Spark lists no others); nothing of them is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        found = found.option("pathGlobFilter", pattern)
    return found.load(path).select("path", "length")


def _scheme(path: Column) -> Column:
    return F.regexp_extract(path, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)


def open_file(path: str) -> pa.NativeFile:
    """A stored file by its path as Spark tells it."""
    if path.startswith("file:") or "://" not in path:
        return pa.OSFile("/" + path.removeprefix("file:").lstrip("/"), "rb")
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_file(place)


def range_digest(path: str, start: int, length: int) -> str:
    """SHA-256 of a range of bytes, read in pieces; a file that ends earlier is an error."""
    digest = hashlib.sha256()
    with open_file(path) as file:
        file.seek(start)
        while length:
            piece = file.read(min(length, PIECE_BYTES))
            if not piece:
                raise OSError(f"{path} ends {length} bytes before its listed length")
            digest.update(piece)
            length -= len(piece)
    return digest.hexdigest()


def _hashed(ranges: DataFrame) -> DataFrame:
    """Add ``sha256`` to ``path, start, length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = (batch.column(c).to_pylist() for c in ("path", "start", "length"))
            digests = pa.array([range_digest(*w) for w in zip(*where)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], names=[*batch.schema.names, "sha256"])

    return ranges.mapInArrow(run, T.StructType([*ranges.schema.fields, T.StructField("sha256", T.StringType())]))


def _dealt(ranges: DataFrame) -> DataFrame:
    """Ranges in hash order over the tasks of a shuffle: a listing is a few large partitions."""
    return ranges.repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "start")


def file_manifest(
    spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, schemes: Sequence[str] = ("file",)
) -> DataFrame:
    """path, length, sha256 of every file (this starts a job over the list of files).

    Files in stores of ``schemes`` are opened by the tasks themselves, which read
    them in pieces of 4 MiB: ``file`` where all machines see the files, and any
    other that ``pyarrow.fs`` knows (``s3``, ``gs``, ..).  Files of other stores
    go through Spark's reader, which holds a file whole and ends with an error
    above 2 GiB.  Empty files are not listed.
    """
    listed = list_files(spark, path, pattern)
    own = _scheme(F.col("path")).isin("", *schemes)
    ranges = listed.where(own).select("path", F.lit(0).cast("bigint").alias("start"), "length")
    streamed = _hashed(_dealt(ranges)).select("path", "length", "sha256")
    if listed.where(~own).isEmpty():
        return streamed
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    whole = reader.load(path).where(~own & (F.col("length") <= _WHOLE_BYTES))
    large = listed.where(~own & (F.col("length") > _WHOLE_BYTES))
    refused = F.raise_error(F.concat(F.lit("above 2 GiB and not in a store that tasks can open: "), "path"))
    return streamed.unionByName(whole.select("path", "length", F.sha2("content", 256).alias("sha256"))).unionByName(
        large.select("path", "length", refused.cast("string").alias("sha256"))
    )


def block_digests(
    spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """path, block (from 0), start, length, sha256 of the blocks of every file that tasks can open; lazy.  Empty files have none."""
    if block_bytes < 1:
        raise ValueError("a block has one byte at least")
    size = F.lit(block_bytes).cast("bigint")
    last = F.floor((F.col("length") - 1) / size).cast("bigint")
    blocks = list_files(spark, path, pattern).select(
        "path", F.col("length").alias("file_length"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block")
    )
    ranges = blocks.select(
        "path",
        "block",
        (F.col("block") * size).alias("start"),
        F.least(size, F.col("file_length") - F.col("block") * size).alias("length"),
    )
    return _hashed(_dealt(ranges))


def digest_trees(blocks: DataFrame, most_blocks: int, fan_out: int = FAN_OUT) -> DataFrame:
    """path, level, node, sha256: the tree over the blocks of each file; lazy.

    Level 0 holds the blocks.  A node above is the SHA-256 of the digests of up
    to ``fan_out`` nodes below, joined in order, so no row gathers more than that;
    there are as many levels as ``most_blocks`` blocks need, and the last has one
    node for each file, :func:`roots`.
    """
    if fan_out < 2:
        raise ValueError("a node joins two digests at least")
    level, found = 0, [blocks.select("path", F.lit(0).alias("level"), F.col("block").alias("node"), "sha256")]
    while most_blocks > 1 or not level:
        level, most_blocks = level + 1, -(-most_blocks // fan_out)
        up = F.floor(F.col("node") / fan_out).cast("bigint")
        parts = F.array_sort(F.collect_list(F.struct("node", "sha256")))
        joined = found[-1].groupBy("path", up.alias("up")).agg(parts.alias("parts"))
        digest = F.sha2(F.array_join(F.col("parts.sha256"), ""), 256)
        found.append(joined.select("path", F.lit(level).alias("level"), F.col("up").alias("node"), digest.alias("sha256")))
    tree = found[0]
    for more in found[1:]:
        tree = tree.unionByName(more)
    return tree


def roots(tree: DataFrame) -> DataFrame:
    """path, root: the digest at the top of each file's tree."""
    return tree.groupBy("path").agg(F.max_by("sha256", "level").alias("root"))


def changed_blocks(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, block, change (``added``, ``removed`` or ``changed``) between two sets of block digests; lazy."""
    old = before.select("path", "block", F.col("sha256").alias("old"))
    new = after.select("path", "block", F.col("sha256").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    differs = ~F.col("old").eqNullSafe(F.col("new"))
    return old.join(new, ["path", "block"], "full").where(differs).select("path", "block", change.alias("change"))
