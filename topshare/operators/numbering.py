"""Row numbers and exact hash cutoffs for groups of any size."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topshare.session import materialize

_BUCKET_DIGITS = 4
_HASH_DIGITS = 32
#: A bucket with more rows is split by further digits of the hash before it is ranked.
_RANKED_ROWS = 1_000_000


def number_rows(
    df: DataFrame,
    order_by: Sequence[Column],
    within: Sequence[str] = (),
    name: str = "row_no",
    max_window_rows: int = 500_000,
    rows_per_range: int = 1_000_000,
) -> DataFrame:
    """Add 1, 2, 3 .. in the given order, overall or per ``within`` group (this starts jobs).

    ``order_by`` has to be a total order.  Groups of a checked size use one
    window; larger ones are range-partitioned in that order, numbered inside
    each range, and shifted by the counts of the ranges before.
    """
    # One non-null key, equal for equal groups, null groups included.
    group = F.struct(*[F.col(f"`{c}`") for c in within]) if within else F.lit(0)
    keyed = df.withColumn("__group", group)
    found = keyed.groupBy("__group").count().agg(F.max("count").alias("largest"), F.sum("count").alias("all")).first()
    if (found["largest"] or 0) <= max_window_rows:
        order = Window.partitionBy("__group").orderBy(*order_by)
        return keyed.withColumn(name, F.row_number().over(order).cast("bigint")).drop("__group")

    ranges = max(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(found["all"] / rows_per_range)
    )
    cut = keyed.repartitionByRange(ranges, F.col("__group"), *order_by).withColumn("__slice", F.spark_partition_id())
    rows, _path = materialize(cut, "numbered")
    keys = ["__slice", "__group"]
    before = Window.partitionBy("__group").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range and group.
    shifts = (
        rows.groupBy(*keys)
        .count()
        .select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    )
    # The window has already placed the rows by the keys of the join.
    local = Window.partitionBy(*keys).orderBy(*order_by)
    numbered = rows.withColumn("__local", F.row_number().over(local).cast("bigint"))
    return numbered.join(shifts, keys).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("__local") + F.col("__before")).alias(name)
    )


def row_hash(keys: Sequence[str], seed: int | str) -> Column:
    """A repeatable pseudo-random order: md5 of seed and key values.

    Each value has its length before it and null is a dash, so different keys
    never make the same text.
    """

    def told(key: str) -> Column:
        text = F.col(f"`{key}`").cast("string")
        return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[told(k) for k in keys]))


def hash_cutoffs(
    hashed: DataFrame,
    groups: Sequence[str],
    quota: Column | Mapping[str, Column],
    hash_name: str = "h",
    ranked_rows: int = _RANKED_ROWS,
    with_size: bool = False,
) -> DataFrame:
    """Per group, the hash of its ``quota``-th row in hash order, as ``cutoff`` (this starts jobs).

    ``quota`` is an expression of the group size ``n``, or several by name, which
    share one count of the rows; the result then has a ``quota_name`` too.  Rows are counted per
    group and hash prefix first; only the one prefix in which the quota ends is
    ranked.  A group that holds a third of all rows is 65,536 parts, and while
    the part of any group has more than ``ranked_rows`` rows, parts are counted
    again by four more digits.  Groups with quota 0 are absent.

    ``with_size`` adds the group's number of rows, as ``n``.
    Both small tables (a row per group) are written out: the planner then knows
    their size and broadcasts them if that is small, or else joins by sorting.
    """
    quotas = quota if isinstance(quota, Mapping) else {"": quota}
    asked = [F.struct(F.lit(name).alias("quota_name"), q.cast("bigint").alias("quota")) for name, q in quotas.items()]
    keys = [*groups, "quota_name"]
    digits = _BUCKET_DIGITS
    narrow = hashed.select(*groups, hash_name, F.substring(hash_name, 1, digits).alias("bucket"))
    before = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = (
        narrow.groupBy(*groups, "bucket")
        .agg(F.count(F.lit(1)).alias("size"))
        .select(
            *groups,
            "bucket",
            "size",
            F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"),
            F.sum("size").over(Window.partitionBy(*groups)).alias("n"),
        )
        .select(*groups, "bucket", "size", "before", "n", F.inline(F.array(*asked)))
    )
    closing = (F.col("before") < F.col("quota")) & (F.col("quota") <= F.col("before") + F.col("size"))
    rest = (F.col("quota") - F.col("before")).alias("rest")
    ending = counted.where(closing).select(*keys, "bucket", "size", "n", rest)
    ending, _path = materialize(ending, "quota-ends")
    shared = [*groups, "bucket"]
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    while digits < _HASH_DIGITS and not ending.where(F.col("size") > ranked_rows).isEmpty():
        digits += _BUCKET_DIGITS
        inside = narrow.join(ending.select(*keys, "bucket", "rest", "n"), shared)
        deeper = inside.withColumn("bucket", F.substring(hash_name, 1, digits))
        narrow = deeper.select(*keys, hash_name, "bucket", "rest", "n")
        # ``rest`` and ``n`` are the same in all rows of a group.
        carried = [F.max(c).alias(c) for c in ("rest", "n")]
        counted = narrow.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("size"), *carried)
        placed = counted.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        closing = (F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("size"))
        rest = (F.col("rest") - F.col("before")).alias("rest")
        ending = placed.where(closing).select(*keys, "bucket", "size", "n", rest)
        ending, _path = materialize(ending, "quota-ends")
        narrow, shared = narrow.drop("rest", "n"), [*keys, "bucket"]
    in_bucket = Window.partitionBy(*keys).orderBy(hash_name)
    cutoffs = (
        narrow.join(ending, shared)
        .withColumn("pos", F.row_number().over(in_bucket))
        .where(F.col("pos") == F.col("rest"))
        .select(
            *(keys if isinstance(quota, Mapping) else groups),
            F.col(hash_name).alias("cutoff"),
            *(["n"] if with_size else []),
        )
    )
    return materialize(cutoffs, "cutoffs")[0]
