"""Findings and risk levels by fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topshare.functions import fixed
from topshare.operators.concentration import GROUP, Concentration
from topshare.operators.timekey import detect_time


def risk_levels(result: Concentration) -> DataFrame:
    """Per group: share of the top 10% and of the largest entity, and the level."""
    if 10 not in result.thresholds:
        raise ValueError("the risk rule reads threshold 10")
    ten = (
        result.metrics()
        .where(F.col("threshold") == 10)
        .select(*GROUP, "entity_count", F.col("pct").alias("top_10_pct"))
    )
    largest = result.head(1).select(
        *GROUP, F.col("entity").alias("largest_entity"), F.col("cumulative_pct").alias("largest_pct")
    )
    level = (
        F.when((F.col("top_10_pct") > fixed.HIGH_SHARE) | (F.col("largest_pct") > fixed.HIGH_SINGLE_SHARE), "high")
        .when(F.col("top_10_pct") >= fixed.MEDIUM_SHARE, "medium")
        .otherwise("low")
    )
    return ten.join(largest, GROUP).withColumn("risk_level", level)


def findings(result: Concentration, column_count: int | None = None, grain: str | None = None) -> DataFrame:
    """kind, text: findings and recommendations about the total."""

    def line(kind: str, text: Column, when: Column | None = None) -> Column:
        entry = F.struct(F.lit(kind).alias("kind"), text.alias("text"))
        return entry if when is None else F.when(when, entry)

    lines = []
    if grain is not None:
        lines.append(line("finding", F.lit(fixed.SHAPE_FINDING.format(columns=column_count, grain=grain))))
        advice = fixed.ADD_TIME if grain == "none" else fixed.USE_TIME.format(grain=grain)
        lines.append(line("recommendation", F.lit(advice)))
        if grain != "none":
            lines.append(line("opportunity", F.lit(fixed.TIME_OPPORTUNITY)))
    share = F.col("pct")
    lines += [
        line(
            "finding",
            F.format_string(fixed.TOP_FINDING, F.col("entity_count"), share),
            share.isNotNull(),
        ),
        line(
            "recommendation",
            F.lit(fixed.DIVERSIFY),
            share > fixed.HIGH_SHARE,
        ),
    ]
    if grain is None:
        lines.append(line("finding", F.lit(fixed.ANALYSIS_PENDING), share.isNull()))
    # The total group is one row; without threshold 10 or in error it has no share.
    ten = result.metrics().where(F.col("is_total") & (F.col("threshold") == 10)).select(*GROUP, "entity_count", "pct")
    total = result.groups.where("is_total").select(*GROUP).join(ten, GROUP, "left")
    return total.select(F.inline(F.filter(F.array(*lines), lambda e: e.isNotNull())))


def analysed_datasets(result: Concentration, dataset_id: str | None = None) -> DataFrame:
    """dataset_id, entity_count, pct of threshold 10: the total as the given dataset, or each group as a dataset.

    Groups without metrics are there with nulls, as they were analysed too.
    """
    ten = result.metrics().where(F.col("threshold") == 10).select(*GROUP, "entity_count", "pct")
    chosen = result.groups.where("is_total" if dataset_id is not None else "NOT is_total").select(*GROUP)
    named = F.col("period") if dataset_id is None else F.lit(dataset_id)
    return chosen.join(ten, GROUP, "left").select(named.alias("dataset_id"), "entity_count", "pct")


def dataset_insights(schemas: DataFrame, analyses: DataFrame) -> DataFrame:
    """Summary and lists of findings of every dataset that is described, analysed or both: one row each.

    ``schemas`` has dataset_id, column_count and period_grain (null: none),
    ``analyses`` what :func:`analysed_datasets` returns; each has one row for a
    dataset, and null ids are left out.  A dataset without analysis has it as a
    pending risk; one without any finding is asked to run it.
    """
    some = F.col("dataset_id").isNotNull()
    described = schemas.where(some).select(
        "dataset_id",
        "column_count",
        F.coalesce(F.col("period_grain"), F.lit("none")).alias("grain"),
    )
    analysed = analyses.where(some).select("dataset_id", "entity_count", "pct", F.lit(True).alias("is_analysed"))
    grain, share = F.col("grain"), F.col("pct")
    shape = F.format_string(fixed.SHAPE_FINDING.format(columns="%d", grain="%s"), F.col("column_count"), grain)
    top = F.format_string(fixed.TOP_FINDING, F.col("entity_count"), share)
    use = F.format_string(fixed.USE_TIME.format(grain="%s"), grain)
    has_time = grain != "none"

    def lines(*texts: Column) -> Column:
        return F.array_compact(F.array(*texts))

    found = lines(F.when(grain.isNotNull(), shape), F.when(share.isNotNull(), top))
    return (
        described.join(analysed, "dataset_id", "full")
        .withColumn("key_findings", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fixed.ANALYSIS_PENDING))))
        .select(
            "dataset_id",
            F.format_string(fixed.EXECUTIVE_SUMMARY, F.col("dataset_id"), F.size("key_findings")).alias(
                "executive_summary"
            ),
            "key_findings",
            lines(F.when(F.col("is_analysed").isNull(), F.lit(fixed.PENDING_RISK))).alias("risk_indicators"),
            lines(F.when(has_time, F.lit(fixed.TIME_OPPORTUNITY))).alias("opportunities"),
            lines(
                F.when(has_time, use).when(grain.isNotNull(), F.lit(fixed.ADD_TIME)),
                F.when(share > fixed.HIGH_SHARE, F.lit(fixed.DIVERSIFY)),
            ).alias("recommendations"),
        )
    )


def insights_of(data: DataFrame, dataset_id: str, result: Concentration | None = None) -> DataFrame:
    """:func:`dataset_insights` of one table: columns and time grain are looked up in it (this starts a job)."""
    spark = data.sparkSession
    facts = (dataset_id, len(data.columns), detect_time(data).grain)
    schemas = spark.createDataFrame([facts], "dataset_id string, column_count int, period_grain string")
    empty = spark.createDataFrame([], "dataset_id string, entity_count bigint, pct double")
    return dataset_insights(schemas, empty if result is None else analysed_datasets(result, dataset_id))
