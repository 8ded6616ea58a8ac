"""Find the time grain of a table and build its period key."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topshare.functions import dates, fixed
from topshare.functions.naming import time_kind

KINDS = ["date", "year", "month", "quarter"]
GRAINS = {
    "date": ["date"],
    "year_month": ["year", "month"],
    "year_quarter": ["year", "quarter"],
    "year": ["year"],
}


@dataclass(frozen=True)
class TimeSpec:
    """Grain, the columns that make the key, every candidate, and warnings."""

    grain: str = "none"
    columns: dict[str, str] = field(default_factory=dict)
    candidates: list[str] = field(default_factory=list)
    grain_candidates: list[str] = field(default_factory=lambda: ["none"])
    warnings: list[str] = field(default_factory=list)


def _kinds(df: DataFrame) -> list[tuple[int, str, str, bool]]:
    """(position, column, kind, is text) of every column that could carry time.

    A text column whose name says nothing, or quarter, is looked at for month
    words too: they come before a quarter name.
    """
    found = []
    for i, f in enumerate(df.schema.fields):
        is_text = isinstance(f.dataType, T.StringType)
        is_time = isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        kind = time_kind(f.name)
        if kind == "date" and not (is_text or is_time):
            continue
        if is_text and kind in (None, "quarter"):
            found.append((i, f.name, "month", True))
        if kind:
            found.append((i, f.name, kind, is_text))
    return found


_CHECKS = (
    "position int, column_name string, kind string, by_name boolean, n bigint, n_valid bigint, hinted boolean, "
    "is_candidate boolean"
)


def time_checks(df: DataFrame) -> DataFrame:
    """column_name, kind, n, n_valid, is_candidate: one pass over the columns in question.

    A column counts if at least 70% of its non-null values fit.  The columns
    are unpivoted, so the plan has the same size for any number of them.
    """
    kinds = _kinds(df)
    if not kinds:
        return df.sparkSession.createDataFrame([], _CHECKS)
    names = list(dict.fromkeys(name for _, name, _, _ in kinds))
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names]).unpivot([], names, "column_name", "text")
    text = F.col("text")

    def valid(kind: str, check: Column, only_text: bool | None = None) -> Column:
        chosen = [n for _, n, k, is_text in kinds if k == kind and only_text in (None, is_text)]
        return F.when(F.col("column_name").isin(chosen), check) if chosen else F.lit(None).cast("boolean")

    flags = {
        "date": F.coalesce(
            valid("date", dates.parse_timestamp(text).isNotNull(), True), valid("date", text.isNotNull(), False)
        ),
        "year": valid("year", dates.plain_number(text).between(fixed.YEAR_MIN, fixed.YEAR_MAX)),
        "month": valid("month", dates.month_like(text)),
        "quarter": valid("quarter", dates.quarter_number(text).isNotNull()),
        "hint": valid("month", text.rlike(dates.MONTH_WORD), True),
    }
    counted = (
        long.where(text.isNotNull())
        .select("column_name", *[flag.alias(k) for k, flag in flags.items()])
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(k), 1)).alias(k) for k in flags])
    )
    # A month column by name needs no month word; any other does.
    facts = [(i, name, kind, not (kind == "month" and time_kind(name) != "month")) for i, name, kind, _ in kinds]
    columns = df.sparkSession.createDataFrame(facts, "position int, column_name string, kind string, by_name boolean")
    picked = F.coalesce(
        *[F.when(F.col("kind") == k, F.col(k)) for k in KINDS],
        F.lit(0),
    )
    joined = columns.join(counted, "column_name", "left").fillna(0, ["n", *flags])
    hinted = F.col("by_name") | (F.col("hint") > 0)
    enough = (F.col("n") > 0) & hinted & (picked >= F.col("n") * fixed.VALID_SHARE)
    return joined.select(
        "position",
        "column_name",
        "kind",
        "by_name",
        "n",
        picked.alias("n_valid"),
        hinted.alias("hinted"),
        enough.alias("is_candidate"),
    )


@dataclass(frozen=True)
class TimeCounts:
    """Of one column: values, and how many of them pass each check; ``hint`` counts month words."""

    n: int = 0
    date: int = 0
    year: int = 0
    month: int = 0
    quarter: int = 0
    hint: int = 0


def detect_time(df: DataFrame) -> TimeSpec:
    """Decide the grain from names and one aggregate (this starts a job)."""
    # At most two rows per column.
    return _decided([(r["position"], r["column_name"], r["kind"], r["hinted"], r["is_candidate"]) for r in time_checks(df).collect()])


def time_spec(df: DataFrame, counts: dict[str, TimeCounts]) -> TimeSpec:
    """As :func:`detect_time` from counts that are there already; of ``df`` only the schema counts."""
    rows = []
    for position, name, kind, _ in _kinds(df):
        found = counts.get(name, TimeCounts())
        hinted = not (kind == "month" and time_kind(name) != "month") or found.hint > 0
        enough = found.n > 0 and hinted and getattr(found, kind) >= found.n * fixed.VALID_SHARE
        rows.append((position, name, kind, hinted, enough))
    return _decided(rows)


def _decided(rows: list[tuple[int, str, str, bool, bool]]) -> TimeSpec:
    """From position, column, kind, whether month words allow it, and whether enough values fit."""
    found: dict[str, list[str]] = {k: [] for k in KINDS}
    with_words: set[str] = set()
    for _, name, kind, hinted, is_candidate in sorted(rows, key=lambda r: (r[0], KINDS.index(r[2]))):
        if kind == "quarter" and name in with_words:
            continue
        if kind == "month" and hinted:
            with_words.add(name)
        if is_candidate:
            found[kind].append(name)
    possible = [grain for grain, kinds in GRAINS.items() if all(found[k] for k in kinds)]
    if not possible:
        return TimeSpec(warnings=[fixed.NO_TIME])
    grain = possible[0]
    warnings = [
        fixed.MANY_TIME_COLUMNS.format(kind=k, names=", ".join(found[k]), first=found[k][0])
        for k in GRAINS[grain]
        if len(found[k]) > 1
    ]
    return TimeSpec(
        grain=grain,
        columns={k: found[k][0] for k in GRAINS[grain]},
        candidates=[c for k in KINDS for c in found[k]],
        grain_candidates=possible,
        warnings=warnings,
    )


def period_key(df: DataFrame, spec: TimeSpec) -> Column:
    """The key as an expression: YYYY-MM-DD, YYYY-Mmm, YYYY-Qq, YYYY, ALL or UNKNOWN."""
    if spec.grain == "none":
        return F.lit(dates.ALL)
    at = {k: F.col(f"`{c}`") for k, c in spec.columns.items()}
    text = {k: isinstance(df.schema[c].dataType, T.StringType) for k, c in spec.columns.items()}
    if spec.grain == "date":
        return dates.date_key(dates.parse_timestamp(at["date"]) if text["date"] else at["date"])
    if spec.grain == "year_month":
        return dates.year_month_key(at["year"], at["month"], text["year"], text["month"])
    if spec.grain == "year_quarter":
        return dates.year_quarter_key(at["year"], at["quarter"], text["year"], text["quarter"])
    return dates.year_key(at["year"], text["year"])


def with_period_key(df: DataFrame, spec: TimeSpec, name: str = "period_key") -> DataFrame:
    return df.withColumn(name, period_key(df, spec))


def unknown_share(df: DataFrame, name: str = "period_key") -> DataFrame:
    """n_rows, n_unknown and the share of rows whose key is UNKNOWN."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col(name) == dates.UNKNOWN, 1)).alias("n_unknown")
    ).withColumn("unknown_share", F.try_divide(F.col("n_unknown").cast("double"), F.col("n_rows").cast("double")))
