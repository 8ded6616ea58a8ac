"""CSV files with line breaks inside quotes, read by as many tasks as the files have splits.

Whether a line begins inside quotes depends on all that stands before it in its
file, which is why such files are commonly read as one split each.  A quoted
field only needs the parity of the quotes before it: one pass counts quotes for
each split, a running sum over the splits of a file (a row for each) tells in
which state each split begins, and then every task puts its own lines together.
A record that goes on in later splits is joined from its pieces, at most one
for each split, by the number of its first line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topshare.session import materialize

_SPLIT = ["path", "split"]
_NAMES = ["path", "split", "whole", "record", "text"]
_PIECES = "path string, split bigint, whole boolean, record bigint, text string"
_BOM = "\ufeff"
#: So many splits, at most, are sent to all tasks with the state in which each begins; beyond, lines move to the states.
_SENT_SPLITS = 100_000


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, split (where it starts), place (grows inside a split), line; only line feeds end a line."""
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("place"),
            F.col("value").alias("line"),
        )
    )


def _split_states(lines: DataFrame) -> DataFrame:
    """For each split that has lines: does it begin inside quotes, and does its file end inside them."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    parity = lines.groupBy(*_SPLIT).agg((F.sum(quotes) % 2).cast("boolean").alias("odd"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.sum(F.col("odd").cast("bigint"))
    inside = F.coalesce(turns.over(before), F.lit(0)) % 2 == 1
    stays_open = turns.over(Window.partitionBy("path")) % 2 == 1
    return parity.select(*_SPLIT, inside.alias("inside"), stays_open.alias("stays_open"))


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of lines that come split by split, in order.

    ``whole`` records begin and end in their split.  The others are pieces: the
    last record of a split that stays open (``record`` is its number), and what
    a split has of a record that began before (``record`` is null).
    """
    split, number, held, head = None, 0, [], False

    def row(text: list[str], whole: bool, record: int | None) -> tuple:
        return (*split, whole, record, "\n".join(text))

    is_open = False
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, splits, inside = (batch.column(c).to_pylist() for c in ("path", "split", "inside"))
        lines = batch.column("line")
        odd = pc.bit_wise_and(pc.count_substring(lines, '"'), 1).to_numpy(zero_copy_only=False)
        first, last = (paths[0], splits[0]), (paths[-1], splits[-1])
        if first == last and not odd.any() and not (is_open if first == split else held or inside[0]):
            # The common case: lines of one split that are all records of their own.
            number = number if first == split else 0
            split, held, head, is_open = first, [], False, False
            numbers = pa.array(range(number, number + batch.num_rows), pa.int64())
            number += batch.num_rows
            columns = [batch.column("path"), batch.column("split"), pa.array([True] * batch.num_rows), numbers, lines]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)
            continue
        texts, rows = lines.to_pylist(), []
        for here, text, turns, begins_inside in zip(zip(paths, splits), texts, odd, inside):
            if here != split:
                if held:
                    rows.append(row(held, False, None if head else number))
                split, number, held, head = here, 0, [], begins_inside
                is_open = begins_inside
            is_open ^= bool(turns)
            held.append(text)
            if not is_open:
                rows.append(row(held, not head, None if head else number))
                number, held, head = number + (not head), [], False
        yield _batch(rows)
    if held:
        yield _batch([row(held, False, None if head else number)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_NAMES)


def _joined(pieces: DataFrame) -> DataFrame:
    """The records that go over several splits, from their pieces: one piece for each split of a record."""
    order = Window.partitionBy("path").orderBy("split", F.col("record").isNotNull())
    started = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.when(F.col("record").isNotNull(), F.struct("split", "record"))
    owned = pieces.withColumn("first", F.last(first, ignorenulls=True).over(started))
    parts = F.array_sort(F.collect_list(F.struct("split", F.col("record").isNull().alias("later"), "text")))
    whole = owned.groupBy("path", "first").agg(parts.alias("parts"))
    return whole.select(
        "path", F.col("first.split").alias("split"), F.col("first.record").alias("record"), F.array_join("parts.text", "\n").alias("text")
    )


def read_csv_records(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """A raw table of text columns, as ``multiLine=True`` gives it, from any number of tasks (this starts jobs).

    Quotes inside quoted fields are doubled and fields are quoted whole, as the
    writers of this package do; what Spark calls ``escape`` other than the quote
    itself is not known here.  Every file has a header; the first one's names
    count.  A record with more or fewer fields is an error unless
    ``mode="PERMISSIVE"`` is given.  So is a file with a quote that is never
    closed; with that mode the rest of it is one record.  A line break inside
    quotes stays as it is in the file; the carriage return of one that ends a
    record goes.  Records of nothing but white space are left out.

    Text with the pieces of records is written to the scratch folder once.
    Files that cannot be split (compressed ones) are one task each.
    """
    known = {"sep", "mode", "nullValue", "emptyValue", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace"}
    if unknown := set(options) - known:
        raise ValueError(f"not an option here: {', '.join(sorted(unknown))}")
    lines = _lines(spark, path)
    states, _ = materialize(_split_states(lines), "csv-states")
    seen = states.agg(F.count(F.lit(1)).alias("splits"), F.max(F.when(F.col("stays_open"), F.col("path"))).alias("open")).first()
    if seen["open"] is not None and options.get("mode", "FAILFAST").upper() != "PERMISSIVE":
        raise ValueError(f"a quote is never closed in {seen['open']}")
    if seen["splits"] <= _SENT_SPLITS:
        placed = lines.join(F.broadcast(states), _SPLIT)
    else:
        placed = lines.join(states, _SPLIT).repartition(*_SPLIT)
    # Either way a task has whole splits.
    placed = placed.sortWithinPartitions(*_SPLIT, "place")
    records, _ = materialize(placed.select(*_SPLIT, "inside", "line").mapInArrow(_put_together, _PIECES), "csv-records")
    whole = records.where("whole").select("path", "split", "record", "text")
    found = whole.unionByName(_joined(records.where("NOT whole")))
    text = F.regexp_replace("text", "\r$", "")
    found = found.withColumn("text", F.when(F.endswith("text", F.lit("\r")), text).otherwise(F.col("text")))

    settings = {"escape": '"', "mode": "FAILFAST", **options}
    is_header = (F.col("split") == 0) & (F.col("record") == 0)
    header = found.where(is_header).orderBy("path").limit(1).select("text").first()
    if header is None:
        return spark.createDataFrame([], T.StructType([]))
    names = _names(spark, header["text"].removeprefix(_BOM), settings.get("sep", ","))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = found.where(~is_header & (F.trim("text") != "")).select(F.from_csv("text", _ddl(names), settings).alias("row"))
    return rows.select(*[F.col(f"row.`{n.replace('`', '``')}`").alias(n) for n in schema.names])


def _names(spark: SparkSession, header: str, sep: str) -> list[str]:
    """Column names as Spark's reader finds them in the text of a header (it takes text in memory as an RDD only)."""
    text = spark.sparkContext.parallelize([header.removesuffix("\r")], 1)
    return spark.read.options(header=True, sep=sep, escape='"').csv(text).columns


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
