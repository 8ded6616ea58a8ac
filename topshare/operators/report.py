"""Report tables made from a concentration analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topshare.functions.dates import ALL
from topshare.functions.fixed import HEAD_ROWS, LISTED_ENTITIES, REPORT_HEAD_ROWS
from topshare.operators.concentration import GROUP, OK, Concentration

_METRIC = "count bigint, value double, percentage double, pct_of_total double"


def long_report(result: Concentration) -> DataFrame:
    """is_total, period, threshold, count, value, pct_of_total (1 decimal), group_by, value_column.

    ``is_total`` keeps a period called TOTAL apart from the total.
    """
    return result.metrics().select(
        *GROUP,
        "threshold",
        F.col("entity_count").alias("count"),
        "value",
        F.round("pct", 1).alias("pct_of_total"),
        F.lit(result.group_by).alias("group_by"),
        F.lit(result.value).alias("value_column"),
    )


def sorted_report(result: Concentration) -> DataFrame:
    """The long report in period and numeric threshold order, for writing."""
    return long_report(result).orderBy(*GROUP, F.col("threshold").cast("int"))


def summary_wide(result: Concentration) -> DataFrame:
    """One row per period: total and count, value, pct of every threshold, in numeric order."""
    wide = (
        result.metrics()
        .groupBy(*GROUP)
        .pivot("threshold", result.thresholds)
        .agg(
            F.first("entity_count").alias("count"),
            F.first("value").alias("value"),
            F.first(F.round("pct", 1)).alias("pct"),
        )
    )
    named = [
        F.col(f"`{x}_{figure}`").alias(f"top_{x}_{figure}")
        for x in result.thresholds
        for figure in ("count", "value", "pct")
    ]
    total = F.when(F.col("status") == OK, F.col("total_value")).otherwise(0.0).alias("total")
    return result.groups.join(wide, GROUP, "left").select(*GROUP, total, *named)


def details(result: Concentration) -> DataFrame:
    """The first ten rows of every period's ranking."""
    return result.head(REPORT_HEAD_ROWS).select(*GROUP, "entity", "value", "cumsum", "cumulative_pct")


def top_entities(result: Concentration) -> DataFrame:
    """As ``details`` with the rank."""
    return result.head(REPORT_HEAD_ROWS).select(
        *GROUP, F.col("rnk").alias("rank"), "entity", "value", "cumsum", "cumulative_pct"
    )


def parameters(result: Concentration) -> DataFrame:
    """Parameter, Value: what the analysis was asked for."""
    rows = [
        ("Group By", result.group_by),
        ("Value Column", result.value),
        ("Time Column", result.period or "none"),
        ("Thresholds", str(result.thresholds)),
    ]
    return result.totals.sparkSession.createDataFrame(rows, "Parameter string, Value string")


def _metric_maps(result: Concentration, share_name: str, with_entities: bool) -> DataFrame:
    """Per group, a map top_X -> figures; at most ten entries."""
    figures = [F.col("entity_count").alias("count"), F.col("value"), F.col("pct").alias(share_name)]
    if with_entities:
        figures.append(F.col("entities"))
    entry = F.struct(F.col("threshold").alias("x"), F.struct(*figures).alias("figures"))
    entries = F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda e: F.struct(F.concat(F.lit("top_"), e["x"].cast("string")), e["figures"]),
    )
    return result.metrics().groupBy(*GROUP).agg(F.map_from_entries(entries).alias("concentration"))


def _heads(result: Concentration, rows: int, name: str) -> DataFrame:
    item = F.struct("rnk", "entity", "value", "cumsum", "cumulative_pct")
    return result.head(rows).groupBy(*GROUP).agg(F.array_sort(F.collect_list(item)).alias(name))


def result_documents(result: Concentration) -> DataFrame:
    """The stored form: one nested document per period and one for the total."""
    return (
        result.groups.join(_metric_maps(result, "percentage", True), GROUP, "left")
        .join(_heads(result, HEAD_ROWS, "head_sample"), GROUP, "left")
        .select(
            *GROUP,
            "total_entities",
            "total_value",
            "concentration",
            "head_sample",
            F.when(F.col("status") != OK, F.col("status")).alias("error"),
        )
    )


def contract(result: Concentration) -> tuple[DataFrame, DataFrame]:
    """The response form: (periods with metrics and head, totals).

    A period called ALL is the only one of a table without time and belongs to the totals.
    """
    documents = (
        result.groups.join(_metric_maps(result, "pct_of_total", False), GROUP, "left")
        .join(_heads(result, REPORT_HEAD_ROWS, "head"), GROUP, "left")
        .withColumn("total", F.when(F.col("status") == OK, F.col("total_value")).otherwise(0.0))
    )
    is_totals = F.col("is_total") | (F.col("period") == ALL)
    return (
        documents.where(~is_totals).select("period", "total", "concentration", "head"),
        documents.where(is_totals).select(
            "period", "total_entities", F.col("total").alias("total_value"), "concentration"
        ),
    )


def report_from_documents(documents: DataFrame, payload: str, period: str = "period") -> DataFrame:
    """Long report rows from stored JSON, of the nested form or of the old one.

    The old form has the ``top_X`` keys on the period itself and may call the
    share ``percentage`` or ``pct_of_total``; each form prefers its own name.
    """
    fields = "map<string,string>"
    root = F.from_json(F.col(payload), fields)
    nested = F.from_json(root["concentration"], fields)
    is_nested = F.coalesce(F.size(nested) > 0, F.lit(False))
    opened = documents.select(
        F.coalesce(F.col(f"`{period}`"), F.lit("TOTAL")).alias("period"),
        is_nested.alias("is_nested"),
        F.explode(F.when(is_nested, nested).otherwise(root)).alias("key", "body"),
    ).where(F.col("key").startswith("top_"))
    figures = opened.withColumn("f", F.from_json("body", _METRIC))
    share: Column = F.when(
        F.col("is_nested"), F.coalesce("f.percentage", "f.pct_of_total", F.lit(0.0))
    ).otherwise(F.coalesce("f.pct_of_total", "f.percentage", F.lit(0.0)))
    return figures.where(F.col("f").isNotNull()).select(
        "period",
        F.regexp_replace("key", "^top_", "").try_cast("int").alias("threshold"),
        F.coalesce("f.count", F.lit(0)).alias("count"),
        F.coalesce("f.value", F.lit(0.0)).alias("value"),
        F.round(share, 1).alias("pct_of_total"),
    )


def entity_lists(result: Concentration) -> DataFrame:
    """period, threshold, and the first names joined by "|"."""
    names = F.array_join(F.transform(F.slice("entities", 1, LISTED_ENTITIES), lambda e: e.cast("string")), "|")
    return result.metrics().select("is_total", "period", "threshold", names.alias("entities"))
