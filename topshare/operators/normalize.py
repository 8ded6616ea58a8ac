"""Clean a raw table: header names, number, percent, date and boolean text.

Which rule a column gets depends on counts over the whole column, so the work
has two steps: one aggregate over all text values (``cascade``), then one lazy
projection (``apply_plans``).  The aggregate runs over the different values of
each batch of rows, column below column: its plan has the same size for ten
columns and for a thousand, and the rows are pre-aggregated per column before
the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topshare.functions import fixed
from topshare.functions.dates import MONTH_WORD, month_like, parse_timestamp, quarter_number
from topshare.functions.naming import says_date_text, says_percent, standard_names, time_kind
from topshare.functions.text_numbers import (
    WHOLE_NUMBER,
    as_boolean,
    parse_numbers,
    percent_share,
    plain_number,
    rescaled,
    stripped,
)
from topshare.operators.timekey import TimeCounts, TimeSpec, time_spec, with_period_key

COUNTERS = [
    "n_present",
    "n_plain",
    "n_integer",
    "n_true_false",
    "successful_coercions",
    "failed_numeric_coercions",
    "currency_removed",
    "parentheses_to_negative",
    "scaling_applied",
    "unicode_minus_normalized",
    "percent_normalized",
    "datetime_parsed",
    "parsing_errors",
    "boolean_coerced",
]

TIME_COUNTERS = [
    *[f"{kind}_{reading}" for kind in ("n", "year", "month", "quarter") for reading in ("text", "number", "share")],
    "hint_text",
]

# Branches that change a column or its description, in the order they are tried.
NUMERIC = "numeric_coercion"
PERCENT = "percent_normalization"
PERCENT_ONLY = "percent_representation"
DATETIME = "datetime_coercion"
BOOLEAN = "boolean_coercion"
STEPS = [NUMERIC, PERCENT, PERCENT_ONLY, DATETIME, BOOLEAN]
# Plain text columns that only need their type.
PLAIN_NUMBERS = "plain_number"
PLAIN_INTEGERS = "plain_integer"
PLAIN_WHOLE = "plain_whole"
PLAIN_DIGITS = "plain_digits"
UNCHANGED = "unchanged"


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "other"


def without_null_tokens(text: Column) -> Column:
    return F.when(~text.isin(fixed.NULL_TOKENS), text)


def value_counts(df: DataFrame) -> DataFrame:
    """column_name, raw, n: the different values of every column of a table of texts, each batch of rows for itself.

    One value may come in several rows, once for each batch that has it.  So a
    task holds no more than a batch, whatever the number of different values;
    columns of few values come out as few rows and those of many as they are, and
    nothing is shuffled.  (The JVM side can merge values only by a shuffle.)
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, column in zip(names, batch.columns):
                found = column.value_counts()
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(name, len(found)), found.field("values").cast(pa.string()), found.field("counts")],
                    names=["column_name", "raw", "n"],
                )

    return df.mapInArrow(run, "column_name string, raw string, n bigint")


def column_counters(df: DataFrame) -> DataFrame:
    """One row per column that has values to judge, with every counter of the cascade and of the time checks.

    Each different value of a batch is parsed once, as number, percent, date and
    time word, and counts as often as it occurs: one pass over the table.
    """
    fields = df.schema.fields
    judged = [
        f.name
        for f in fields
        if _kind(f.dataType) in ("text", "boolean") or (_kind(f.dataType) == "number" and says_percent(f.name))
    ]
    dated = [f.name for f in fields if _kind(f.dataType) in ("text", "time") and (says_date_text(f.name) or time_kind(f.name) == "date")]
    timed = [f.name for f in fields if time_kind(f.name) in ("year", "month", "quarter")]
    worded = [f.name for f in fields if _kind(f.dataType) == "text" and time_kind(f.name) in (None, "month", "quarter")]
    chosen = list(dict.fromkeys(judged + dated + timed))
    names = chosen or df.columns[:1]
    long = value_counts(df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names]))
    long = long.select("column_name", "n", without_null_tokens(F.col("raw")).alias("raw"), F.col("raw").alias("value"))

    def among(columns: list[str], check: Column) -> Column:
        return F.when(F.col("column_name").isin(columns), check) if columns else F.lit(None).cast("boolean")

    percent_names = [c for c in names if says_percent(c)]
    under_percent = F.col("column_name").isin(percent_names) if percent_names else F.lit(False)
    value = F.col("value")
    # Text after the null tokens: null where there is no value to judge.
    parsed = parse_numbers(long, ["value"]).withColumn("text", F.when(F.col("raw").isNotNull(), value["text"]))
    text = F.col("text")
    # Whole numbers: 1 fits BIGINT, 2 DECIMAL, 3 neither; null for all other text.
    fits = F.when(text.try_cast("bigint").isNotNull(), 1).when(text.try_cast("decimal(38,0)").isNotNull(), 2).otherwise(3)
    parsed = parsed.withColumns(
        {
            "whole": F.when(value["plain"] & text.rlike(WHOLE_NUMBER), fits),
            "share": percent_share(text, False, clean=True),
            "is_date": among(dated, parse_timestamp(F.col("raw")).isNotNull()),
            "quarter": among(timed, quarter_number(F.col("raw")).isNotNull()),
            "month": among([*timed, *worded], month_like(F.col("raw"))),
            "hint": among(worded, F.col("raw").rlike(MONTH_WORD)),
        }
    )
    whole = F.col("whole")
    large = value["plain"] & (value["number"] > 1) & (value["number"] <= 100)
    times = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    # A null token is no value: nothing in it counts.
    count = lambda cond: times((text != "") & cond)
    counted = parsed.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        times(F.col("raw").isNotNull()).alias("n_present"),
        count(F.lit(True)).alias("n_filled"),
        count(value["plain"]).alias("n_plain"),
        count(whole <= 3).alias("n_whole"),
        count(whole == 1).alias("n_integer"),
        count(whole <= 2).alias("n_decimal"),
        count(text.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias("n_true_false"),
        count(value["coerced"]).alias("successful_coercions"),
        count(value["failed"]).alias("failed_numeric_coercions"),
        F.coalesce(F.sum(F.when(text != "", value["currency"] * F.col("n"))), F.lit(0)).alias("currency_removed"),
        count(value["parentheses"]).alias("parentheses_to_negative"),
        count(value["scaled"]).alias("scaling_applied"),
        count(value["minus"]).alias("unicode_minus_normalized"),
        count(F.col("share.changed") | (under_percent & large)).alias("percent_normalized"),
        count(F.lower(text).isin(fixed.TRUE_WORDS + fixed.FALSE_WORDS)).alias("boolean_coerced"),
        count(F.col("is_date")).alias("datetime_parsed"),
        count(~F.col("is_date")).alias("parsing_errors"),
        # How often a value is a year, month or quarter: read as text, and as the number or the share that it is cleaned to.
        *_time_counts(times, timed, under_percent, large),
        # Two conventions and nine currencies exist: these lists are short.
        F.array_sort(F.collect_set(F.when(text != "", value["convention"]))).alias("conventions"),
        F.collect_set(F.when(text != "", value["symbols"])).alias("symbols"),
        F.collect_set(F.when(text != "", value["code"])).alias("codes"),
    )
    currencies = F.array_sort(F.array_union(F.flatten("symbols"), F.col("codes")))
    return counted.withColumn("currencies", currencies).drop("symbols", "codes")


def _time_counts(times, timed: list[str], under_percent: Column, large: Column) -> list[Column]:
    present = F.col("raw").isNotNull()
    as_text = F.when(F.col("value")["plain"], F.col("value")["number"])
    as_number = F.col("value")["number"]
    as_share = F.when(under_percent & large, as_number / 100).otherwise(F.col("share.number"))
    found = []
    for reading, number in {"text": as_text, "number": as_number, "share": as_share}.items():
        whole = F.when(~F.isnan(number), number.try_cast("bigint"))
        checks = {
            "year": number.between(fixed.YEAR_MIN, fixed.YEAR_MAX),
            "month": F.col("month") if reading == "text" else whole.between(1, 12),
            "quarter": F.col("quarter") if reading == "text" else whole.between(1, 4),
        }
        known = F.col("column_name").isin(timed) if timed else F.lit(False)
        for kind, check in checks.items():
            inside = present if reading == "text" and kind == "month" else present & known
            found.append(times(inside & check).alias(f"{kind}_{reading}"))
        found.append(times(present if reading == "text" else present & number.isNotNull()).alias(f"n_{reading}"))
    return [*found, times(present & F.col("hint")).alias("hint_text")]


def cascade(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """One row per column: its branch, counters, conventions and currencies.

    ``df`` has standard names; ``names`` maps them to the original headers.
    """
    names = names or {c: c for c in df.columns}
    facts = [
        (
            i,
            f.name,
            str(names[f.name]),
            _kind(f.dataType),
            f.dataType.simpleString(),
            says_percent(f.name),
            says_date_text(f.name),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    schema = (
        "position int, column_name string, original_name string, kind string, source_type string, "
        "percent_name boolean, date_name boolean"
    )
    columns = df.sparkSession.createDataFrame(facts, schema)
    found = columns.join(column_counters(df), "column_name", "left")
    zeros = {c: 0 for c in [*COUNTERS, *TIME_COUNTERS, "n_rows", "n_filled", "n_whole", "n_decimal"]}
    found = found.fillna(zeros)

    text = F.col("kind") == "text"
    filled = F.col("n_filled")
    is_plain = text & (filled > 0) & (F.col("n_plain") == filled)
    is_logical = F.col("n_present") * fixed.VALID_SHARE <= F.col("boolean_coerced")
    # Whole numbers never become DOUBLE, which would merge long ids: BIGINT, DECIMAL or, beyond 38 digits, text.
    typed = (
        F.when(F.col("n_integer") == filled, PLAIN_INTEGERS)
        .when(F.col("n_decimal") == filled, PLAIN_WHOLE)
        .when(F.col("n_whole") == filled, PLAIN_DIGITS)
        .otherwise(PLAIN_NUMBERS)
    )
    branch = (
        F.when(text & ~is_plain & (F.col("n_true_false") < filled) & (F.col("successful_coercions") > 0), NUMERIC)
        .when(F.col("kind").isin("text", "number") & (F.col("percent_normalized") > 0), PERCENT)
        .when(is_plain & ~F.col("percent_name"), typed)
        .when(F.col("percent_name"), PERCENT_ONLY)
        .when(F.col("kind").isin("text", "time") & F.col("date_name") & (F.col("datetime_parsed") > 0), DATETIME)
        .when(F.col("kind").isin("text", "boolean") & (F.col("boolean_coerced") > 0) & is_logical, BOOLEAN)
        .otherwise(UNCHANGED)
    )
    numeric = F.col("branch") == NUMERIC
    return (
        found.withColumn("branch", branch)
        .withColumn("typed", F.when(is_plain, typed))
        .withColumn(
            "representation",
            F.when(F.col("percent_name") | (F.col("branch") == PERCENT), F.lit("percent")),
        )
        .withColumn(
            "decimal_convention",
            F.when(numeric & (F.size("conventions") > 1), "mixed").when(
                numeric & (F.size("conventions") == 1), F.col("conventions")[0]
            ),
        )
        .withColumn("currencies", F.when(numeric, F.col("currencies")).otherwise(F.array().cast("array<string>")))
        .withColumn("multi_currency", F.size("currencies") > 1)
        .withColumn("failed_ratio", F.try_divide(F.col("failed_numeric_coercions").cast("double"), filled.cast("double")))
        .drop("conventions", "n_whole", "n_decimal")
        .orderBy("position")
    )


@dataclass(frozen=True)
class ColumnPlan:
    """What happens to one column.  ``counters`` holds only what its branch counted."""

    name: str
    original_name: str
    source_type: str
    branch: str
    typed: str | None
    representation: str | None
    decimal_convention: str | None
    currencies: list[str]
    counters: dict[str, int]
    failed_ratio: float | None


_COUNTED = {
    NUMERIC: [
        "successful_coercions", "failed_numeric_coercions", "currency_removed", "parentheses_to_negative",
        "scaling_applied", "unicode_minus_normalized",
    ],
    PERCENT: ["percent_normalized"],
    PERCENT_ONLY: ["percent_normalized"],
    DATETIME: ["datetime_parsed", "parsing_errors"],
    BOOLEAN: ["boolean_coerced"],
}


def plan_normalization(df: DataFrame, names: dict[str, str] | None = None) -> list[ColumnPlan]:
    """Decide every column's branch (this starts one job; the result has one row per column)."""
    return plans_from(cascade(df, names))


def plans_from(rows: DataFrame) -> list[ColumnPlan]:
    """The rows of :func:`cascade`, collected."""
    return _plans(rows.collect())


def _plans(rows: list[Row]) -> list[ColumnPlan]:
    return [
        ColumnPlan(
            name=r["column_name"],
            original_name=r["original_name"],
            source_type=r["source_type"],
            branch=r["branch"],
            typed=r["typed"],
            representation=r["representation"],
            decimal_convention=r["decimal_convention"],
            currencies=list(r["currencies"] or []),
            counters={c: r[c] for c in _COUNTED.get(r["branch"], [])},
            failed_ratio=r["failed_ratio"],
        )
        for r in rows
    ]


def apply_plans(df: DataFrame, plans: list[ColumnPlan]) -> DataFrame:
    """The cleaned table, lazily.  Text that its column's branch cannot read is null."""
    by_name = {p.name: p for p in plans}
    texts = {f.name for f in df.schema.fields if _kind(f.dataType) == "text"}
    cleaned = df.select(
        *[without_null_tokens(F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns]
    )
    numbers = [p.name for p in plans if p.branch == NUMERIC]
    if numbers:
        cleaned = parse_numbers(cleaned, numbers)

    def value(name: str) -> Column:
        plan, column = by_name[name], F.col(f"`{name}`")
        text = name in texts
        if plan.branch == NUMERIC:
            return column["number"]
        if plan.branch == PERCENT:
            if not text:
                return rescaled(column.cast("double"))
            return percent_share(column, says_percent(name))["number"]
        if plan.typed == PLAIN_INTEGERS:
            return stripped(column).cast("bigint")
        if plan.typed == PLAIN_WHOLE:
            return stripped(column).cast("decimal(38,0)")
        if plan.typed == PLAIN_DIGITS:
            return stripped(column)
        if plan.typed == PLAIN_NUMBERS:
            return plain_number(column)
        if plan.branch == DATETIME and text:
            return parse_timestamp(column)
        if plan.branch == BOOLEAN and text:
            return as_boolean(column)
        return column

    return cleaned.select(*[value(c).alias(c) for c in df.columns])


@dataclass(frozen=True)
class Normalized:
    """The cleaned table with its ``period_key`` and how it came about."""

    data: DataFrame
    plans: list[ColumnPlan]
    time: TimeSpec
    warnings: list[str]
    names: dict[str, str]

    def transformations(self) -> list[dict]:
        """Header step plus one step per changed or described column."""
        steps: list[dict] = [{"step": "header_standardization", "columns": list(self.names)}]
        for p in self.plans:
            if p.branch in STEPS:
                steps.append({"step": p.branch, "column": p.name, "counters": p.counters})
        return steps


def _cleaned_time_counts(row: Row, data_type: T.DataType) -> TimeCounts:
    """What the time checks find in a column once it is cleaned, from the counts over its raw values."""
    if row["kind"] == "text" and row["branch"] == DATETIME:
        return TimeCounts(n=row["datetime_parsed"], date=row["datetime_parsed"])
    if row["kind"] == "text" and row["branch"] == BOOLEAN:
        return TimeCounts(n=row["boolean_coerced"])
    if row["branch"] == PERCENT:
        reading = "share"
    elif row["kind"] == "text" and _kind(data_type) == "number":
        reading = "number"
    else:
        reading = "text"
    n = row[f"n_{reading}"]
    return TimeCounts(
        n=n,
        date=n if _kind(data_type) == "time" else row["datetime_parsed"],
        year=row[f"year_{reading}"],
        month=row[f"month_{reading}"],
        quarter=row[f"quarter_{reading}"],
        hint=row["hint_text"] if reading == "text" else 0,
    )


def normalize(df: DataFrame) -> Normalized:
    """Clean ``df`` (this starts one job, which reads the table once and counts for all rules and time checks)."""
    names = standard_names(df.columns)
    renamed = df.toDF(*names)
    rows = cascade(renamed, names).collect()
    if not any(r["n_rows"] for r in rows):
        raise ValueError("the input has no rows")
    plans = _plans(rows)
    data = apply_plans(renamed, plans)
    spec = time_spec(data, {r["column_name"]: _cleaned_time_counts(r, data.schema[r["column_name"]].dataType) for r in rows})
    warnings = [
        fixed.MIXED_CONVENTIONS.format(name=p.name)
        for p in plans
        if p.decimal_convention == "mixed"
    ]
    return Normalized(with_period_key(data, spec), plans, spec, warnings + spec.warnings, names)
