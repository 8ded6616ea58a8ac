"""Column profile: nulls, cardinality, outliers, negatives, roles.

Means, deviations and negatives come from one wide aggregate, outliers from a
second with those as constants; wide tables are done some columns at a time, so
plans stay small and every column is read once in each pass.  Distinct counts
run over unpivoted columns: exact ones group by (column, value) with map-side
combine, so a value that holds a third of all rows is one row per task before
the shuffle; sketches need no shuffle of values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topshare.functions import fixed
from topshare.functions.naming import may_be_negative

#: Columns in one aggregate.
_AT_ONCE = 40
_TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _key(df: DataFrame, name: str) -> Column:
    """A value as a short text that is equal exactly when the value is."""
    column, data_type = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        # -0.0 equals 0.0, NaN is null.
        column = F.when(column == 0, F.lit(0.0).cast(data_type)).otherwise(F.nanvl(column, F.lit(None).cast(data_type)))
    text = column.cast("string")
    if isinstance(data_type, T.StringType):
        # Long texts are compared by digest, to keep the shuffle small.
        return F.when(F.length(text) > 64, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)
    return text


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, value, n: rows per distinct value, null included."""
    names = columns or df.columns
    long = df.select(*[_key(df, c).alias(c) for c in names]).unpivot([], names, "column_name", "value")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def null_and_distinct(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """column_name, n_rows, null_count, cardinality (non-null)."""
    names = columns or df.columns
    if exact:
        return (
            value_counts(df, names)
            .groupBy("column_name")
            .agg(
                F.sum("n").alias("n_rows"),
                F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
                F.count("value").alias("cardinality"),
            )
        )
    long = df.select(*[_key(df, c).alias(c) for c in names]).unpivot([], names, "column_name", "value")
    return long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("null_count"),
        F.approx_count_distinct("value", 0.02).alias("cardinality"),
    )


def _wide(df: DataFrame, names: Sequence[str], figures: Callable[[str, Column], dict[str, Column]]) -> list[dict]:
    """Figures of each column, ``_AT_ONCE`` columns in one aggregate; every column is read once (this starts jobs)."""
    found = []
    for start in range(0, len(names), _AT_ONCE):
        batch = {c: figures(c, _number(df, c)) for c in names[start : start + _AT_ONCE]}
        row = df.agg(*[x.alias(f"{i}|{f}") for i, own in enumerate(batch.values()) for f, x in own.items()]).first()
        found += [{"column_name": c} | {f: row[f"{i}|{f}"] for f in own} for i, (c, own) in enumerate(batch.items())]
    return found


def _number(df: DataFrame, name: str) -> Column:
    return F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double"))


def _figures(df: DataFrame) -> list[dict]:
    return _wide(
        df,
        numeric_columns(df),
        lambda _, x: {
            "n_values": F.count(x),
            "mean": F.avg(x),
            "std": F.stddev_samp(x),
            "negative_count": F.count_if(F.coalesce(x < 0, F.lit(False))),
        },
    )


def _frame(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    return df.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


_FIGURES_SCHEMA = "column_name string, n_values bigint, mean double, std double, negative_count bigint"


def number_figures(df: DataFrame) -> DataFrame:
    """column_name, n_values, mean, std (sample), negative_count per numeric column (this starts jobs)."""
    return _frame(df, _figures(df), _FIGURES_SCHEMA)


def outliers(df: DataFrame) -> DataFrame:
    """column_name, n_values, outlier_count, outlier_rate: farther than 3 sigma from the mean (this starts jobs)."""
    return _outliers(df, _figures(df))


def _outliers(df: DataFrame, figures: list[dict]) -> DataFrame:
    """A second pass with the mean and deviation of each column as constants."""
    known = {r["column_name"]: r for r in figures if r["std"]}

    def far(name: str, x: Column) -> dict[str, Column]:
        limit = fixed.OUTLIER_SIGMAS * known[name]["std"]
        return {"far": F.count_if(F.coalesce(F.abs(x - F.lit(known[name]["mean"])) > F.lit(limit), F.lit(False)))}

    counts = {r["column_name"]: r["far"] for r in _wide(df, list(known), far)}
    rows = [
        r | {"outlier_count": (n := counts.get(r["column_name"], 0)), "outlier_rate": n / r["n_values"] if r["n_values"] else 0.0}
        for r in figures
    ]
    return _frame(df, rows, "column_name string, n_values bigint, outlier_count bigint, outlier_rate double")


def negative_policy(df: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Numeric columns with negatives: count, rate, and a warning unless the name allows them."""
    extra = [a.lower() for a in allowed or []]
    permitted = [c for c in numeric_columns(df) if may_be_negative(c) or any(a in c.lower() for a in extra)]
    is_allowed = F.col("column_name").isin(permitted) if permitted else F.lit(False)
    return (
        number_figures(df)
        .where(F.col("negative_count") > 0)
        .select(
            "column_name",
            "negative_count",
            (F.col("negative_count").cast("double") / F.col("n_values").cast("double")).alias("negative_rate"),
            is_allowed.alias("is_allowed"),
            F.when(
                ~is_allowed,
                F.format_string(fixed.UNEXPECTED_NEGATIVES, F.col("column_name"), F.col("negative_count")),
            ).alias("warning"),
        )
    )


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: type, role, nulls, cardinality, outliers, negatives and flags."""
    facts = []
    for i, f in enumerate(df.schema.fields):
        kind = "number" if isinstance(f.dataType, T.NumericType) else "other"
        kind = "time" if isinstance(f.dataType, _TIME_TYPES) else kind
        facts.append((i, f.name, f.dataType.simpleString(), kind))
    columns = df.sparkSession.createDataFrame(facts, "position int, column_name string, dtype string, kind string")
    found = columns.join(null_and_distinct(df, exact=exact), "column_name", "left").fillna(
        0, ["n_rows", "null_count", "cardinality"]
    )
    if numeric_columns(df):
        rows = _figures(df)
        figures = _frame(df, rows, _FIGURES_SCHEMA).select("column_name", "mean", "std", "negative_count")
        found = found.join(figures, "column_name", "left").join(
            _outliers(df, rows).select("column_name", "outlier_count", "outlier_rate"), "column_name", "left"
        )
    else:
        nothing = F.lit(None)
        found = found.select(
            "*",
            nothing.cast("double").alias("mean"),
            nothing.cast("double").alias("std"),
            nothing.cast("bigint").alias("negative_count"),
            nothing.cast("bigint").alias("outlier_count"),
            nothing.cast("double").alias("outlier_rate"),
        )
    rows, distinct = F.col("n_rows"), F.col("cardinality")
    level = F.least(F.lit(50), F.greatest(F.lit(5), F.floor(rows / 10)))
    role = (
        F.when((F.col("kind") == "number") & ((distinct > level) | (distinct > rows * 0.5)), "numeric")
        .when(F.col("kind") == "time", "datetime")
        .otherwise("categorical")
    )
    null_rate = F.coalesce(F.try_divide(F.col("null_count").cast("double"), rows.cast("double")), F.lit(0.0))
    return found.select(
        "position",
        "column_name",
        "dtype",
        role.alias("role"),
        "n_rows",
        "null_count",
        null_rate.alias("null_rate"),
        (null_rate > fixed.HIGH_NULL_RATE).alias("high_null_rate"),
        "cardinality",
        ((rows > fixed.LOW_CARDINALITY_ROWS) & (distinct < fixed.LOW_CARDINALITY)).alias("low_cardinality"),
        "mean",
        "std",
        "negative_count",
        "outlier_count",
        "outlier_rate",
    )


def column_kinds(df: DataFrame) -> DataFrame:
    """column_name, kind: time, group, value or other, as the samplers choose them."""
    time_names = {"date", "period", "month", "quarter", "year"}
    texts, fixed_kinds = [], []
    for i, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, _TIME_TYPES) or f.name.lower() in time_names:
            fixed_kinds.append((i, f.name, "time"))
        elif isinstance(f.dataType, T.StringType):
            texts.append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            fixed_kinds.append((i, f.name, "value"))
        else:
            fixed_kinds.append((i, f.name, "other"))
    schema = "position int, column_name string, kind string"
    known = df.sparkSession.createDataFrame(fixed_kinds, schema)
    if not texts:
        return known
    position = F.create_map(*[F.lit(v) for c in texts for v in (c, df.columns.index(c))])
    judged = null_and_distinct(df, texts).select(
        position[F.col("column_name")].alias("position"),
        "column_name",
        F.when(F.col("cardinality") < F.col("n_rows") * 0.5, "group").otherwise("other").alias("kind"),
    )
    return known.unionByName(judged)


def dataset_metadata(df: DataFrame, columns: DataFrame, cascade_rows: DataFrame) -> DataFrame:
    """One row: row and column counts, currencies, time dimension.

    ``columns`` comes from :func:`profile`, ``cascade_rows`` from the cleaning plan.
    """
    shape = columns.agg(
        F.max("n_rows").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.coalesce(F.max(F.col("role") == "datetime"), F.lit(False)).alias("has_time_dimension"),
    )
    money = cascade_rows.agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("currencies")))).alias("currencies_detected")
    ).withColumn("multi_currency", F.size("currencies_detected") > 1)
    return one_row(shape, money)


def one_row(*frames: DataFrame) -> DataFrame:
    """Frames of one row each, side by side."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def transformation_summary(cascade_rows: DataFrame) -> DataFrame:
    """Steps taken (the header step included), columns touched, and the kinds of step."""
    from topshare.operators.normalize import STEPS

    used = F.col("branch").isin(STEPS)
    return cascade_rows.agg(
        (F.count(F.when(used, 1)) + 1).alias("total_transformations"),
        F.count(F.when(used, 1)).alias("columns_modified"),
        F.array_sort(
            F.array_union(F.collect_set(F.when(used, F.col("branch"))), F.array(F.lit("header_standardization")))
        ).alias("transformation_types"),
    )
