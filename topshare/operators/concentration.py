"""Who holds how much of a total, per period and overall.

The measure is summed once per (period, entity) with map-side combine and
written to a scratch table; the overall sums are built from that table, so the
input is scanned once.  Every view below reads those two tables.

Ranking inside a group (a period, or the overall total) needs an order, and
the overall group holds every entity.  Groups of a checked size are ranked
with a window.  Beyond that size the rows are range-partitioned in rank order,
each range gets local running sums and the offsets of the ranges before it,
so that no task ever holds a whole group.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topshare.functions.fixed import (
    DEFAULT_THRESHOLDS,
    EMPTY_GROUP,
    HEAD_ROWS,
    LARGE_ENTITY_COUNT,
    LARGE_MESSAGE,
    LISTED_ENTITIES,
    MAX_THRESHOLDS,
    NON_POSITIVE,
    OUT_OF_RANGE,
)
from topshare.session import materialize, release

TOTAL = "TOTAL"
OK = "ok"
GROUP = ["is_total", "period"]
_FIGURES = ["amount", "fine", "beyond", "n_rows"]
_PLACES = 6
_AMOUNT = T.DecimalType(38, _PLACES)
_BEYOND = 1e24
#: A group whose absolute sum reaches this is out of range: a hundred times it still fits ``_AMOUNT``.
_MOST = 1e29
#: The parts of an amount that are ranked and summed, and the names of their running sums and totals.
_LIMBS = {"amount": ("cumsum", "total"), "fine": ("cumsum_fine", "total_fine")}


def check_thresholds(thresholds: Iterable[int] | None) -> list[int]:
    """Sorted distinct integer percents; the rules are checked before any job runs."""
    if thresholds is None:
        return list(DEFAULT_THRESHOLDS)
    given = list(thresholds)
    if not given:
        raise ValueError("at least one threshold is needed")
    if len(given) > MAX_THRESHOLDS:
        raise ValueError(f"at most {MAX_THRESHOLDS} thresholds are allowed")
    if any(isinstance(x, bool) or not isinstance(x, int) or not 1 <= x <= 100 for x in given):
        raise ValueError("thresholds are integers from 1 to 100")
    return sorted(set(given))


def _need_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"column not found: {', '.join(missing)}; available: {', '.join(df.columns)}")


def without_nan(df: DataFrame, name: str) -> Column:
    """NaN counts as null everywhere in this package."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(column, F.lit(None).cast(df.schema[name].dataType))
    return column


def _checked(df: DataFrame, group_by: str, value: str, period: str | None, scale: int | None) -> None:
    _need_columns(df, group_by, value, *([period] if period else []))
    if scale is not None and not 0 <= scale <= _PLACES:
        raise ValueError(f"scale is 0 to {_PLACES} decimals, or None for all that can be kept")
    if not isinstance(df.schema[value].dataType, T.NumericType):
        raise ValueError(f"column {value} is not numeric")


def _summed(df: DataFrame, group_by: str, value: str, period: str | None, scale: int | None) -> DataFrame:
    """Exact sums per (period, entity), null periods included: the one pass over the input."""
    parts, sums = _exact_sums(df, value, scale)
    label = without_nan(df, period).cast("string") if period else F.lit(TOTAL)
    rows = df.select(label.alias("period"), without_nan(df, group_by).alias("entity"), *parts)
    return _carried(rows.groupBy("period", "entity").agg(*sums, F.count(F.lit(1)).alias("n_rows")))


def _overall(summed: DataFrame) -> DataFrame:
    """Sums per entity from the sums per period."""
    figures = [F.sum(c).alias(c) for c in ("amount", "fine", "beyond", "n_rows")]
    return _carried(summed.groupBy("entity").agg(*figures)).select(
        F.lit(True).alias("is_total"), F.lit(TOTAL).alias("period"), "entity", *_FIGURES
    )


def _per_period(summed: DataFrame) -> DataFrame:
    return summed.where(F.col("period").isNotNull()).select(
        F.lit(False).alias("is_total"), "period", "entity", *_FIGURES
    )


def _exact_sums(df: DataFrame, value: str, scale: int | None) -> tuple[list[Column], list[Column]]:
    """Columns to add before grouping, and the aggregates that sum them exactly.

    ``amount`` counts millionths, ``fine`` what is left of each value below
    them, in units of ``10**-15``, and ``beyond`` the values that are too large
    for an exact sum (``_BEYOND`` and more, infinities included).

    Summing every row as DECIMAL costs several times a BIGINT sum.  A value
    whose count of millionths fits a double exactly is therefore split into two
    integers of 24 and 28 bits, whose BIGINT sums cannot overflow at any
    realistic row count; only larger values go through DECIMAL.
    """
    column = without_nan(df, value)
    kind = df.schema[value].dataType
    wide = T.DecimalType(30, _PLACES)
    kept = _PLACES if scale is None else scale
    beyond = F.abs(column.cast("double")) >= F.lit(_BEYOND)
    none = F.lit(None).cast("bigint")
    if isinstance(kind, T.DecimalType):
        split = scale is None and kind.scale > _PLACES
        # A remainder keeps all its decimals, a difference of wide decimals would not.
        below = column % F.lit("0.000001").cast("decimal(6,6)")
        coarse = F.when(~beyond, (column - below if split else F.round(column, kept)).cast(wide))
        rest = (below * F.lit(10**15).cast("decimal(16,0)")).cast("bigint")
        high, low, large, fine = none, none, coarse, rest if split else none
    else:
        number = column.cast("double")
        small = F.abs(number) < float(2**52 // 10**_PLACES)
        units = F.when(small, F.rint(number * F.lit(float(10**kept))).cast("bigint") * F.lit(10 ** (_PLACES - kept)))
        high, low = F.shiftright(units, 24), units.bitwiseAND(F.lit(2**24 - 1))
        large = F.when(~small & ~beyond, F.round(column, kept).cast(wide))
        # A value of six decimals at most leaves exactly nothing.
        rest = F.rint((number - units / F.lit(float(10**_PLACES))) * F.lit(1e15)).cast("bigint")
        fine = rest if scale is None and isinstance(kind, T.FractionalType) else none
    parts = [high.alias("high"), low.alias("low"), large.alias("large"), fine.alias("fine"), beyond.alias("beyond")]
    whole = F.sum("high").cast("decimal(38,0)") * F.lit(2**24) + F.sum("low").cast("decimal(38,0)")
    small_sum = (whole.cast("decimal(38,0)") / F.lit(10**_PLACES).cast("decimal(7,0)")).cast(_AMOUNT)
    nothing = F.lit(0).cast(wide)
    amount = F.coalesce(small_sum, nothing) + F.coalesce(F.sum("large"), nothing)
    return parts, [
        amount.cast(_AMOUNT).alias("amount"),
        F.coalesce(F.sum("fine"), F.lit(0).cast("bigint")).alias("fine"),
        F.count_if(F.coalesce("beyond", F.lit(False))).alias("beyond"),
    ]


def _carry(amount: Column, fine: Column) -> tuple[Column, Column]:
    """Both with the whole millionths of ``fine`` moved to ``amount``; what is left is 0 to ``10**9 - 1``."""
    rest = F.pmod(fine, F.lit(10**9))
    whole = ((fine - rest).cast("decimal(20,0)") / F.lit(10**15).cast("decimal(16,0)")).cast("decimal(20,6)")
    return (amount + whole).cast(_AMOUNT), rest


def _carried(sums: DataFrame, amount: str = "amount", fine: str = "fine") -> DataFrame:
    return sums.withColumns(dict(zip((amount, fine), _carry(F.col(amount), F.col(fine)))))


def _group_figures(totals: DataFrame) -> DataFrame:
    """One row per period plus exactly one total row, even for empty input."""
    held = F.col("entity").isNotNull()
    figures = [
        F.count("entity").alias("total_entities"),
        F.sum(F.when(held, F.col("amount"))).alias("amount"),
        F.sum(F.when(held, F.col("fine"))).alias("fine"),
        F.sum(F.when(held, F.col("beyond"))).alias("beyond"),
        F.sum(F.when(held, F.abs("amount").cast("double"))).alias("mass"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("input_rows"),
    ]
    per_period = totals.where(~F.col("is_total")).groupBy(*GROUP).agg(*figures)
    overall = totals.where(F.col("is_total")).agg(*figures)
    overall = overall.select(F.lit(True).alias("is_total"), F.lit(TOTAL).alias("period"), *overall.columns)
    groups = _carried(per_period.unionByName(overall))
    status = (
        F.when(F.col("total_entities") == 0, F.lit(EMPTY_GROUP))
        .when((F.col("beyond") > 0) | (F.col("mass") >= _MOST), F.lit(OUT_OF_RANGE))
        .when((F.col("amount") < 0) | ((F.col("amount") == 0) & (F.col("fine") == 0)), F.lit(NON_POSITIVE))
        .otherwise(F.lit(OK))
    )
    total = F.col("amount").cast("double") + F.col("fine").cast("double") / F.lit(1e15)
    return groups.select(*GROUP, "total_entities", total.alias("total_value"), "input_rows", status.alias("status"))


def places_for(finest: int, mass) -> int:
    """Decimals that ranking keeps: ``finest``, or as many as leave running sums times 100 within 38 digits."""
    digits = len(str(int(mass)))
    places = min(finest, 36 - digits)
    return places if digits <= 26 else min(places, 32 - digits)


def in_units(held: DataFrame, places: int, mass) -> DataFrame:
    """Amounts as whole units of ``10**-places``: BIGINT if no running sum times 100 can overflow."""
    unit_type = "bigint" if mass * 10**places * 100 < 2**63 else "decimal(38,0)"
    coarse = min(places, _PLACES)
    # Scale down before the factor, or the product would lose decimals.
    exact = F.col("amount").cast(T.DecimalType(32, coarse)) * F.lit(10**coarse).cast("decimal(7,0)")
    if places > _PLACES:
        below = F.col("fine").cast("decimal(10,0)") / F.lit(10 ** (15 - places)).cast("decimal(10,0)")
        exact = exact.cast("decimal(38,0)") * F.lit(10 ** (places - _PLACES)).cast("decimal(10,0)")
        exact = exact.cast("decimal(38,0)") + F.round(below, 0).cast("decimal(10,0)")
    return held.select(*GROUP, "entity", exact.cast(unit_type).alias("amount"), "beyond")


def in_limbs(held: DataFrame) -> DataFrame:
    """Amounts as millionths (``amount``) and units of ``10**-15`` below (``fine``), for sums that no single type holds."""
    return held.select(*GROUP, "entity", "amount", "fine", "beyond")


def _limbs(df: DataFrame) -> list[str]:
    return [c for c in _LIMBS if c in df.columns]


def _ranking(df: DataFrame) -> list[Column]:
    """Value descending, then name."""
    return [*[F.col(c).desc() for c in _limbs(df)], F.col("entity").asc()]


def _positive(ranked: DataFrame) -> DataFrame:
    """Sums of two limbs in their normal form, and the groups that have metrics."""
    whole = F.col("total") > 0
    if "fine" in ranked.columns:
        for amount, fine in zip(_LIMBS["amount"], _LIMBS["fine"]):
            ranked = _carried(ranked, amount, fine)
        whole = whole | ((F.col("total") == 0) & (F.col("total_fine") > 0))
    return ranked.where(whole & (F.col("beyond") == 0)).drop("beyond")


def rank_by_window(totals: DataFrame) -> DataFrame:
    """Rank and running sum with one window per group; for groups of a checked size."""
    order = Window.partitionBy(*GROUP).orderBy(*_ranking(totals))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*GROUP)
    limbs = _limbs(totals)
    ranked = totals.select(
        *GROUP,
        "entity",
        *limbs,
        F.row_number().over(order).cast("bigint").alias("rnk"),
        *[F.sum(c).over(running).alias(_LIMBS[c][0]) for c in limbs],
        *[F.sum(c).over(whole).alias(_LIMBS[c][1]) for c in limbs],
        F.sum("beyond").over(whole).alias("beyond"),
    )
    return _positive(ranked)


def rank_by_ranges(totals: DataFrame, ranges: int) -> tuple[DataFrame, str]:
    """As :func:`rank_by_window` plus the column ``slice``, for groups of any size.

    The range number is written out with the rows: sampling other bounds in a
    second run would otherwise mix two numberings.
    """
    cut = totals.repartitionByRange(ranges, F.col("is_total"), F.col("period"), *_ranking(totals)).withColumn(
        "slice", F.spark_partition_id()
    )
    rows, path = materialize(cut, "ranges")
    keys, limbs = ["slice", *GROUP], _limbs(totals)

    # At most one row per range and group: small, and spread over the groups.
    before = Window.partitionBy(*GROUP).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*GROUP)
    offsets = (
        rows.groupBy(*keys)
        .agg(*[F.sum(c).alias(c) for c in limbs], F.sum("beyond").alias("beyond"), F.count(F.lit(1)).alias("part_rows"))
        .select(
            *keys,
            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in limbs],
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
            *[F.sum(c).over(whole).alias(_LIMBS[c][1]) for c in limbs],
            F.sum("beyond").over(whole).alias("beyond"),
        )
    )
    order = Window.partitionBy(*keys).orderBy(*_ranking(totals))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select(
        *keys,
        "entity",
        *limbs,
        F.row_number().over(order).cast("bigint").alias("local_rnk"),
        *[F.sum(c).over(running).alias(f"{c}_local") for c in limbs],
    )
    kinds = {c: rows.schema[c].dataType for c in limbs}
    ranked = local.join(offsets, keys).select(
        *GROUP,
        "slice",
        "entity",
        *limbs,
        (F.col("local_rnk") + F.col("rows_before")).alias("rnk"),
        *[(F.col(f"{c}_local") + F.col(f"{c}_before")).cast(kinds[c]).alias(_LIMBS[c][0]) for c in limbs],
        *[F.col(_LIMBS[c][1]).cast(kinds[c]).alias(_LIMBS[c][1]) for c in limbs],
        "beyond",
    )
    return _positive(ranked), path


@dataclass(frozen=True)
class Concentration:
    """The views of one analysis.  All are lazy reads of the scratch tables.

    ``units`` and ``ranked`` hold amounts in units of ``10**-places``, or, where no
    type holds the sums of all groups in units of one size, as millionths and
    what is below them (``fine``, in units of ``10**-15``).
    """

    totals: DataFrame
    units: DataFrame
    ranked: DataFrame
    places: int
    group_by: str
    value: str
    period: str | None
    thresholds: list[int]
    paths: list[str] = field(default_factory=list)

    def release(self) -> None:
        """Delete the scratch tables; the views cannot be read afterwards."""
        for path in self.paths:
            release(self.totals.sparkSession, path)

    def _plain(self, name: str, fine: str | None = None) -> Column:
        """An amount as a number; ``fine`` names what is below it, where there is such a column."""
        if "fine" not in self.units.columns:
            return F.col(name).cast("double") / F.lit(float(10**self.places))
        return F.col(name).cast("double") + F.col(fine).cast("double") / F.lit(1e15)

    def _within(self, percent: int) -> Column:
        """Whether the running share is at most ``percent``, exactly."""
        if "fine" not in self.units.columns:
            return F.col("cumsum") * F.lit(100) <= F.col("total") * F.lit(percent)
        held, held_fine = _carry(F.col("cumsum") * F.lit(100), F.col("cumsum_fine") * F.lit(100))
        most, most_fine = _carry(F.col("total") * F.lit(percent), F.col("total_fine") * F.lit(percent))
        return (held < most) | ((held == most) & (held_fine <= most_fine))

    @cached_property
    def groups(self) -> DataFrame:
        """is_total, period, total_entities, total_value, input_rows, status."""
        return _group_figures(self.totals)

    def periods(self) -> DataFrame:
        """Distinct periods in order."""
        return self.totals.where(~F.col("is_total")).select("period").distinct().orderBy("period")

    def metrics(self) -> DataFrame:
        """One row per group and threshold: entity_count, value, pct, entities.

        An entity qualifies while its running share is at most the threshold.
        With negative values that is not a prefix of the ranking, so each
        figure is a conditional aggregate.  The first entity stands in if none
        qualifies.
        """
        # Same partitioning and order as the ranking, so its sort is reused.
        keys = [k for k in ("slice", *GROUP) if k in self.ranked.columns]
        order = Window.partitionBy(*keys).orderBy(*_ranking(self.ranked))
        running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        limbs = _limbs(self.ranked)
        kept = {x: self._within(x) for x in self.thresholds}
        flagged = self.ranked.select("*", *[cond.alias(f"ok_{x}") for x, cond in kept.items()])
        numbered = flagged.select(
            "*", *[F.count(F.when(F.col(f"ok_{x}"), 1)).over(running).alias(f"seen_{x}") for x in self.thresholds]
        )

        first = F.col("rnk") == 1
        figures = [
            *[F.max(_LIMBS[c][1]).alias(_LIMBS[c][1]) for c in limbs],
            *[F.max(F.when(first, F.col(c))).alias(f"first_{c}") for c in limbs],
            F.max(F.when(first, F.col("entity"))).alias("first_entity"),
        ]
        for x in self.thresholds:
            ok = F.col(f"ok_{x}")
            # A slice offers its first few qualifying names only; the lists stay short.
            listed = F.when(ok & (F.col(f"seen_{x}") <= LISTED_ENTITIES), F.struct("rnk", "entity"))
            figures += [
                F.count(F.when(ok, 1)).alias(f"n_{x}"),
                *[F.sum(F.when(ok, F.col(c))).alias(f"{c}_{x}") for c in limbs],
                F.collect_list(listed).alias(f"e_{x}"),
            ]
        wide = numbered.groupBy(*GROUP).agg(*figures)

        def one(x: int) -> Column:
            none = F.col(f"n_{x}") == 0
            names = F.transform(F.slice(F.array_sort(f"e_{x}"), 1, LISTED_ENTITIES), lambda s: s["entity"])
            value = F.when(none, self._plain("first_amount", "first_fine")).otherwise(self._plain(f"amount_{x}", f"fine_{x}"))
            return F.struct(
                F.lit(x).alias("threshold"),
                F.greatest(F.col(f"n_{x}"), F.lit(1)).alias("entity_count"),
                value.alias("value"),
                (value / self._plain("total", "total_fine") * 100).alias("pct"),
                F.when(none, F.array("first_entity")).otherwise(names).alias("entities"),
            )

        return wide.select(*GROUP, F.inline(F.array(*[one(x) for x in self.thresholds])))

    def head(self, rows: int = HEAD_ROWS) -> DataFrame:
        """The first rows of each group's ranking with running sum and share.

        A top-k of its own: a task sends at most ``rows`` entities per group
        (window group limit), whatever the size of the group.
        """
        order = Window.partitionBy(*GROUP).orderBy(*_ranking(self.units))
        first = self.units.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= rows)
        running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = first.withColumns({_LIMBS[c][0]: F.sum(c).over(running) for c in _limbs(first)})
        fine = self.groups.where(F.col("status") == OK).select(*GROUP, "total_value")
        return summed.join(fine, GROUP).select(
            *GROUP,
            F.col("rnk").cast("bigint").alias("rnk"),
            "entity",
            self._plain("amount", "fine").alias("value"),
            self._plain("cumsum", "cumsum_fine").alias("cumsum"),
            (self._plain("cumsum", "cumsum_fine") / F.col("total_value") * 100).alias("cumulative_pct"),
        )

    def summary(self) -> DataFrame:
        """Per period: entities and value; groups in error show zeros."""
        fine = F.col("status") == OK
        return self.groups.where(~F.col("is_total")).select(
            "period",
            F.when(fine, F.col("total_entities")).otherwise(0).alias("entities"),
            F.when(fine, F.col("total_value")).otherwise(0.0).alias("value"),
            "status",
        )

    def overview(self) -> DataFrame:
        """One row about the whole run."""
        return self.groups.agg(
            F.lit("multi_period" if self.period else "single_period").alias("analysis_type"),
            F.count(F.lit(1)).alias("periods_analyzed"),
            F.max(F.when(F.col("is_total"), F.col("input_rows"))).alias("total_input_rows"),
        ).withColumn("thresholds", F.array(*[F.lit(x) for x in self.thresholds]))

    def size_warnings(self, limit: int = LARGE_ENTITY_COUNT) -> DataFrame:
        """Groups with more entities than the warning level."""
        return self.groups.where(F.col("total_entities") > limit).select(
            *GROUP, "total_entities", _size_message(limit).alias("message")
        )

    def step_log(self, limit: int = LARGE_ENTITY_COUNT) -> DataFrame:
        """What was computed, as rows: step, status, period and figures."""
        no_count, no_value = F.lit(None).cast("bigint"), F.lit(None).cast("double")

        def step(name: Column, status: str, count=no_count, value=no_value, message=None) -> Column:
            return F.struct(
                name.alias("step"),
                F.lit(status).alias("status"),
                count.alias("entities_count"),
                value.alias("total_value"),
                (message if message is not None else F.lit(None).cast("string")).alias("message"),
            )

        named = lambda prefix: F.concat(F.lit(prefix), F.col("period"))
        size, total = F.col("total_entities"), F.coalesce(F.col("total_value"), F.lit(0.0))
        steps = F.array(
            step(named("aggregation_"), "completed", size, total),
            F.when(size > limit, step(named("performance_warning_"), "warning", size, message=_size_message(limit))),
            F.when(
                F.col("status") == OK,
                step(
                    named("concentration_calculation_"),
                    "completed",
                    message=F.lit(f"{len(self.thresholds)} thresholds calculated"),
                ),
            ),
            F.when(F.col("status") != OK, step(named("error_"), "failed", message=F.col("status"))),
        )
        per_group = self.groups.select(*GROUP, F.inline(F.filter(steps, lambda s: s.isNotNull())))
        closing = self.groups.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(True).alias("is_total"),
            F.lit(None).cast("string").alias("period"),
            F.lit("summary_generation").alias("step"),
            F.lit("completed").alias("status"),
            no_count.alias("entities_count"),
            no_value.alias("total_value"),
            F.concat(F.col("n"), F.lit(" periods analyzed")).alias("message"),
        )
        log = per_group.unionByName(closing)
        if not self.period:
            return log
        # The ten smallest names (a top-k) and one count row, folded into one row.
        names = self.groups.where(~F.col("is_total")).select("period")
        smallest = names.orderBy("period").limit(10).select("period", F.lit(None).cast("bigint").alias("n"))
        found = names.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("period"), "n")
        listed = F.array_join(F.array_sort(F.collect_list("period")), ", ")
        opening = (
            smallest.unionByName(found)
            .agg(listed.alias("names"), F.max("n").alias("n"))
            .select(
                F.lit(False).alias("is_total"),
                F.lit(None).cast("string").alias("period"),
                F.lit("period_identification").alias("step"),
                F.lit("completed").alias("status"),
                no_count.alias("entities_count"),
                no_value.alias("total_value"),
                F.concat(F.col("n"), F.lit(" periods found: "), F.col("names")).alias("message"),
            )
        )
        return opening.unionByName(log)

    def formulas(self) -> dict[str, str]:
        """How each figure is defined."""
        texts = {
            "aggregation": f"sum({self.value}) per {self.group_by}, per period and overall",
            "sorting": f"value descending, then {self.group_by} ascending",
            "cumulative_percentage": "running sum / total * 100",
        }
        for x in self.thresholds:
            texts[f"top_{x}"] = f"count and sum of entities with cumulative_percentage <= {x}, at least the first"
        return texts


def _size_message(limit: int) -> Column:
    return F.format_string(LARGE_MESSAGE, F.col("total_entities"), F.lit(limit))


def concentrate(
    df: DataFrame,
    group_by: str,
    value: str,
    period: str | None = None,
    thresholds: Iterable[int] | None = None,
    *,
    scale: int | None = None,
    max_window_rows: int = 500_000,
    rows_per_range: int = 1_000_000,
) -> Concentration:
    """Run the aggregation (this starts jobs) and return the analysis views.

    Values are summed exactly: 15 decimals, or ``scale`` (0 to 6) if that is
    given, for values below 10**24.  Larger ones and infinities, and absolute
    sums of 10**29 and more, give their group a status and no metrics.  So the
    threshold cuts are independent of row order and partitioning.  Ranking keeps
    all decimals that occur, whatever the sizes in other groups: where no type
    holds sums of all groups in one unit, amounts are ranked in two parts.  A group with more than ``max_window_rows`` entities is
    ranked by ranges.
    """
    cuts = check_thresholds(thresholds)
    _checked(df, group_by, value, period, scale)
    summed, path = materialize(_summed(df, group_by, value, period, scale), "sums")
    totals, paths = _overall(summed), [path]
    if period is not None:
        totals, path = materialize(totals, "overall")
        totals = _per_period(summed).unionByName(totals)
        paths.append(path)
    held = totals.where(F.col("entity").isNotNull())
    sizes = _sizes(held)
    if (sizes["mass"] or 0) >= _MOST:
        fine = _group_figures(totals).where(F.col("status") == OK).select(*GROUP)
        held = held.join(fine, GROUP, "left_semi")
        sizes = _sizes(held)
    finest = 15 if sizes["finest"] else _PLACES if sizes["finer"] else 2
    mass = sizes["mass"] or 0
    units = in_units(held, finest, mass) if places_for(finest, mass) == finest else in_limbs(held)
    if (sizes["rows"] or 0) <= max_window_rows:
        ranked = rank_by_window(units)
    else:
        shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranked, cut = rank_by_ranges(units, max(shuffles, math.ceil(sizes["all"] / rows_per_range)))
        paths.append(cut)
    return Concentration(totals, units, ranked, finest, group_by, value, period, cuts, paths)


def _sizes(held: DataFrame) -> Row:
    """rows and mass of the largest group, whether there are cents' parts or less, and all rows (this starts a job)."""
    cents = F.lit("0.01").cast("decimal(3,2)")
    return (
        held.groupBy(*GROUP)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.abs("amount") + F.lit(1)).alias("mass"),
            F.count_if(F.col("amount") % cents != 0).alias("finer"),
            F.count_if(F.col("fine") != 0).alias("finest"),
        )
        .agg(*[F.max(c).alias(c) for c in ("rows", "mass", "finer", "finest")], F.sum("rows").alias("all"))
        .first()
    )
