"""Repeatable samples and null injection.

"Random" is the order of md5(seed | key): exact sizes, the same rows in every
run and for every partitioning.  ``keys`` has to identify a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topshare.operators.concentration import without_nan
from topshare.operators.numbering import hash_cutoffs, number_rows, row_hash
from topshare.operators.picks import Pick, first_keys
from topshare.session import materialize

SPECIAL_CHARACTERS = r"(?U)[^\w\s]"


def _ordered(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"`{k}`").asc() for k in keys]


def random_sample(df: DataFrame, keys: Sequence[str], percentage: float = 20.0, seed: int = 42) -> DataFrame:
    """Exactly int(rows * percentage / 100) rows (finding the cutoff starts jobs, here and below)."""
    return random_samples(df, keys, [percentage], seed)[percentage]


def random_samples(
    df: DataFrame, keys: Sequence[str], percentages: Sequence[float], seed: int = 42
) -> dict[float, DataFrame]:
    """Samples of several sizes from one count of the rows; a smaller one is part of every larger one."""
    mark = row_hash(keys, seed)
    hashed = df.select(F.lit("all").alias("g"), mark.alias("h"))
    quotas = {str(p): F.floor(F.col("n") * F.lit(p / 100)) for p in percentages}
    # One cutoff per percentage.
    cuts = {r["quota_name"]: r["cutoff"] for r in hash_cutoffs(hashed, ["g"], quotas).collect()}
    return {p: df.where(mark <= F.lit(cuts[str(p)])) if str(p) in cuts else df.limit(0) for p in percentages}


def stratified_sample(
    df: DataFrame,
    group: str,
    keys: Sequence[str],
    percentage: float = 20.0,
    seed: int = 42,
    most_broadcast: int = 10_000,
) -> DataFrame:
    """round(size * percentage / 100) rows per group, halves to even; rows with a null group are left out.

    No group is gathered in a task.  Cutoffs of up to ``most_broadcast`` groups
    (counted) are broadcast.  Of more groups, those that hold at least one in
    ``most_broadcast`` of the rows cannot be more than that; their cutoffs are
    broadcast and their rows decided where they are read.  Only rows of the
    smaller groups, as far as their hash is no larger than the largest of these
    cutoffs, are shuffled to meet theirs.
    """
    hashed = df.where(F.col(f"`{group}`").isNotNull()).withColumn("h", row_hash(keys, seed))
    cutoffs = hash_cutoffs(hashed, [group], F.rint(F.col("n") * (percentage / 100)), with_size=True)
    found = cutoffs.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")).first()

    def taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
        joined = rows.join(cuts.select(group, "cutoff"), group)
        return joined.where(F.col("h") <= F.col("cutoff")).select(*df.columns)

    if found["groups"] <= most_broadcast:
        return taken(hashed, F.broadcast(cutoffs))
    is_large = F.col("n") * most_broadcast >= found["rows"]
    large, small = cutoffs.where(is_large), cutoffs.where(~is_large)
    decided = taken(hashed, F.broadcast(large))
    highest = small.agg(F.max("cutoff").alias("h")).first()["h"]
    if highest is None:
        return decided
    rest = hashed.where(F.col("h") <= F.lit(highest)).join(F.broadcast(large.select(group)), group, "left_anti")
    return decided.unionAll(taken(rest, small))


def time_balanced_sample(
    df: DataFrame, period: str, keys: Sequence[str], rows_per_period: int = 10, seed: int = 42
) -> DataFrame:
    """``rows_per_period`` rows of every period, all rows of smaller ones.

    The rank filter is applied before the shuffle too (window group limit),
    so a task sends at most that many rows per period.
    """
    order = Window.partitionBy(period).orderBy("h", *_ordered(keys))
    return (
        df.where(F.col(f"`{period}`").isNotNull())
        .withColumn("h", row_hash(keys, seed))
        .withColumn("pos", F.row_number().over(order))
        .where(F.col("pos") <= rows_per_period)
        .select(*df.columns)
    )


def top_entities(df: DataFrame, group: str, value: str, top_n: int = 10) -> DataFrame:
    """The ``top_n`` entities by total value, ties by name."""
    total = F.sum(without_nan(df, value).cast("decimal(28,6)")).alias("total_value")
    sums = df.where(F.col(f"`{group}`").isNotNull()).groupBy(group).agg(total)
    return sums.orderBy(F.col("total_value").desc_nulls_last(), F.col(f"`{group}`").asc()).limit(top_n)


def top_entities_sample(df: DataFrame, group: str, value: str, top_n: int = 10) -> DataFrame:
    """All rows of the top entities: a semi join with ``top_n`` names, which Spark broadcasts if they are few."""
    return df.join(top_entities(df, group, value, top_n).select(group), group, "left_semi").select(*df.columns)


def has_null(df: DataFrame) -> Column:
    """Whether any column is null; NaN counts as null, here as everywhere in this package."""
    return reduce(or_, [without_nan(df, c).isNull() for c in df.columns])


def edge_cases_sample(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    texts: Sequence[str] = (),
    force_nulls: bool = True,
    preserve: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Rows with nulls, extreme values and special characters, without repeats (this starts jobs).

    At most 5 null rows, 2 smallest and 2 largest of up to three measures and
    3 special rows of up to two text columns.  One scan finds the at most 23
    keys, a second one reads their rows whole.
    """
    picks = [Pick(5, has_null(df))]
    for v in list(values)[:3]:
        column = without_nan(df, v)
        picks += [Pick(2, F.lit(True), column), Pick(2, F.lit(True), column, descending=True)]
    for t in list(texts)[:2]:
        picks.append(Pick(3, F.col(f"`{t}`").rlike(SPECIAL_CHARACTERS)))
    names = list(keys)
    chosen, _path = materialize(first_keys(df, names, picks), "edge-keys")
    if chosen.isEmpty():
        found = random_sample(df, keys, 10.0, seed)
    else:
        whole = df.join(F.broadcast(chosen), names, "left_semi").select(*df.columns)
        found, _path = materialize(whole, "edge-rows")
    if force_nulls and found.where(has_null(found)).isEmpty():
        kept = keys if preserve is None else preserve
        found = add_random_nulls(found, keys, 15.0, [c for c in df.columns if c not in kept], seed)
    return found


def add_random_nulls(
    df: DataFrame,
    keys: Sequence[str],
    null_percentage: float = 10.0,
    columns: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Null out max(1, int(rows * pct / 100)) values of each column, chosen per column; keys stay."""
    targets = [c for c in (columns or df.columns) if c not in keys]
    if not targets:
        return df
    marks = {c: row_hash(keys, f"{seed}|{c}") for c in targets}
    long = df.select(*[marks[c].alias(c) for c in targets]).unpivot([], targets, "target", "h")
    quota = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(null_percentage) / 100))
    # One cutoff per column.
    cuts = {r["target"]: r["cutoff"] for r in hash_cutoffs(long, ["target"], quota).collect()}
    return df.select(
        *[
            F.when(marks[c] > F.lit(cuts[c]), F.col(f"`{c}`")).alias(c) if c in cuts else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def add_column_nulls(
    df: DataFrame,
    column: str,
    keys: Sequence[str],
    null_percentage: float = 20.0,
    pattern: str = "random",
    seed: int = 42,
) -> DataFrame:
    """Null out one column: random, first_n, last_n or every_nth row in key order (this starts jobs)."""
    if column not in df.columns:
        raise ValueError(f"column not found: {column}")
    if pattern == "random":
        return add_random_nulls(df, keys, null_percentage, [column], seed)
    if pattern not in ("first_n", "last_n", "every_nth"):
        raise ValueError(f"unknown pattern {pattern}: use random, first_n, last_n or every_nth")
    n = df.count()
    chosen = min(max(1, int(n * null_percentage / 100)), n)
    # Only keys are numbered; the rows to change are found by them.
    numbered = number_rows(df.select(*[F.col(f"`{k}`") for k in keys]), _ordered(keys))
    row = F.col("row_no")
    step = max(1, n // chosen) if chosen else 1
    hit = {
        "first_n": row <= chosen,
        "last_n": row > n - chosen,
        "every_nth": ((row - 1) % step == 0) & ((row - 1) / step < chosen),
    }[pattern]
    found = numbered.where(hit).select(*[F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys)], F.lit(True).alias("__hit"))
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)])
    return df.join(found, same, "left").select(
        *[F.when(F.col("__hit").isNull(), F.col(f"`{c}`")).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns]
    )


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
