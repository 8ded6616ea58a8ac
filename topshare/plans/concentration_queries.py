"""Concentration, reports and findings over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from topshare.functions import dates
from topshare.operators import insight, report
from topshare.operators.concentration import concentrate
from topshare.plans.common import (
    METRICS_SQL,
    SQL_MONTH,
    SQL_QUARTER,
    concentration_sql,
    metrics,
    month_of,
    quarter_of,
    table,
    year_of,
)

QUERIES, ORACLES = {}, {}


def _orders(spark, d):
    return table(spark, d, "orders")


def _by_priority(spark, d, thresholds=None, **options):
    return concentrate(_orders(spark, d), "o_custkey", "o_totalprice", "o_orderpriority", thresholds, **options)


_PRIORITY_SOURCE = "SELECT o_custkey AS entity, o_orderpriority AS period, o_totalprice AS value FROM orders"

# -- total and each grain -------------------------------------------------


def concentration_total(spark, d):
    return metrics(concentrate(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice"))


ORACLES["concentration_total"] = (
    concentration_sql("SELECT l_suppkey AS entity, NULL AS period, l_extendedprice AS value FROM lineitem") + METRICS_SQL
)


def concentration_by_quarter(spark, d):
    lines = table(spark, d, "lineitem").withColumn("quarter_key", quarter_of("l_shipdate"))
    return metrics(concentrate(lines, "l_suppkey", "l_extendedprice", "quarter_key"))


_QUARTER_SOURCE = (
    f"SELECT l_suppkey AS entity, {SQL_QUARTER.format('l_shipdate')} AS period, l_extendedprice AS value FROM lineitem"
)
ORACLES["concentration_by_quarter"] = concentration_sql(_QUARTER_SOURCE) + METRICS_SQL


def concentration_by_quarter_ranges(spark, d):
    """The same result through range partitioning, the way for groups of any size."""
    lines = table(spark, d, "lineitem").withColumn("quarter_key", quarter_of("l_shipdate"))
    return metrics(concentrate(lines, "l_suppkey", "l_extendedprice", "quarter_key", max_window_rows=0))


ORACLES["concentration_by_quarter_ranges"] = ORACLES["concentration_by_quarter"]


def concentration_by_month(spark, d):
    orders = _orders(spark, d).withColumn("month_key", month_of("o_orderdate"))
    return metrics(concentrate(orders, "o_custkey", "o_totalprice", "month_key"))


ORACLES["concentration_by_month"] = (
    concentration_sql(
        f"SELECT o_custkey AS entity, {SQL_MONTH.format('o_orderdate')} AS period, o_totalprice AS value FROM orders"
    )
    + METRICS_SQL
)


def concentration_by_date_key(spark, d):
    events = table(spark, d, "events").withColumn("day_key", dates.date_key(F.col("ts")))
    return metrics(concentrate(events, "user_id", "value", "day_key"))


ORACLES["concentration_by_date_key"] = (
    concentration_sql("SELECT user_id AS entity, strftime(ts, '%Y-%m-%d') AS period, value FROM events") + METRICS_SQL
)


def concentration_by_year(spark, d):
    lines = table(spark, d, "lineitem").withColumn("year_key", year_of("l_shipdate"))
    return metrics(concentrate(lines, "l_partkey", "l_extendedprice", "year_key"))


ORACLES["concentration_by_year"] = (
    concentration_sql(
        "SELECT l_partkey AS entity, CAST(year(l_shipdate) AS VARCHAR) AS period, l_extendedprice AS value FROM lineitem"
    )
    + METRICS_SQL
)


def concentration_none_grain(spark, d):
    parts = table(spark, d, "part").withColumn("period_key", F.lit(dates.ALL))
    return metrics(concentrate(parts, "p_brand", "p_retailprice", "period_key"))


ORACLES["concentration_none_grain"] = (
    concentration_sql("SELECT p_brand AS entity, 'ALL' AS period, p_retailprice AS value FROM part") + METRICS_SQL
)



def _fine_amounts(spark, d, **options):
    """Sums of micro amounts: periods far below a millionth, and amounts that differ in the sixth decimal only."""
    lines = table(spark, d, "lineitem").select(
        "l_suppkey",
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("line"),
        F.when(F.col("l_linenumber") == 1, F.col("l_quantity") / F.lit(1e9))
        .when(F.col("l_linenumber") == 2, F.lit(10.0) + (F.col("l_suppkey") % 7) / F.lit(1e6))
        .otherwise(F.col("l_extendedprice") + (F.col("l_suppkey") % 9) / F.lit(1e6))
        .alias("amount"),
    )
    found = concentrate(lines, "l_suppkey", "amount", "line", **options).metrics()
    # Nine decimals of a period below a millionth, six of the others.
    value = F.when(F.col("period") == "L1", F.round(F.col("value") * 1e9, 3)).otherwise(F.round("value", 5))
    return found.where(~F.col("is_total")).select("period", "threshold", "entity_count", value.alias("value"), F.round("pct", 5).alias("pct"))


def concentration_fine_amounts(spark, d):
    return _fine_amounts(spark, d)


def concentration_fine_amounts_ranges(spark, d):
    """The same result through range partitioning."""
    return _fine_amounts(spark, d, max_window_rows=0)


_FINE_SQL = """
WITH src AS (
  SELECT l_suppkey AS entity, 'L' || l_linenumber AS period,
         CASE WHEN l_linenumber = 1 THEN CAST(round(l_quantity * 1000000) AS HUGEINT)
              WHEN l_linenumber = 2 THEN 10000000000000000 + (l_suppkey % 7) * 1000000000
              ELSE CAST(round(l_extendedprice * 1000000) AS HUGEINT) * 1000000000 + (l_suppkey % 9) * 1000000000 END AS units
  FROM lineitem
),
e AS (SELECT period, entity, sum(units) AS amount FROM src GROUP BY period, entity),
r AS (
  SELECT *, sum(amount) OVER (PARTITION BY period) AS total,
         row_number() OVER (PARTITION BY period ORDER BY amount DESC, entity) AS rnk,
         sum(amount) OVER (PARTITION BY period ORDER BY amount DESC, entity ROWS UNBOUNDED PRECEDING) AS cumsum
  FROM e
),
m AS (
  SELECT period, x AS threshold, greatest(count(*) FILTER (WHERE cumsum * 100 <= total * x), 1) AS entity_count,
         coalesce(sum(amount) FILTER (WHERE cumsum * 100 <= total * x), max(amount) FILTER (WHERE rnk = 1)) AS v, max(total) AS total
  FROM r CROSS JOIN (SELECT unnest([10, 20, 50]) AS x) GROUP BY period, x
)
SELECT period, threshold, entity_count,
       CASE WHEN period = 'L1' THEN round(CAST(v AS DOUBLE) / 1e6, 3) ELSE round(CAST(v AS DOUBLE) / 1e15, 5) END AS value,
       round(CAST(v AS DOUBLE) / CAST(total AS DOUBLE) * 100, 5) AS pct
FROM m
"""
ORACLES["concentration_fine_amounts"] = _FINE_SQL
ORACLES["concentration_fine_amounts_ranges"] = _FINE_SQL


def _mixed_sizes(spark, d, **options):
    """Periods of very large, very small, ordinary and mixed amounts, some 36 digits apart; all have all their decimals."""
    orders = table(spark, d, "orders")
    digit = (F.col("o_custkey") % 9 + 1).cast("string")
    large, small = (F.concat(digit, F.lit(e)).cast("double") for e in ("e20", "e-13"))
    mixed = F.when(F.col("o_custkey") % 3 == 0, large).otherwise(small)
    amount = (
        F.when(F.col("o_orderpriority") == "1-URGENT", large)
        .when(F.col("o_orderpriority") == "2-HIGH", small)
        .when(F.col("o_orderpriority") == "5-LOW", mixed)
        .otherwise(F.col("o_totalprice"))
    )
    result = concentrate(orders.withColumn("amount", amount), "o_custkey", "amount", "o_orderpriority", [5, 20, 50, 99, 100], **options)
    return result.metrics().select(
        "is_total",
        "period",
        "threshold",
        "entity_count",
        F.round("pct", 6).alias("pct"),
        F.array_join(F.col("entities").cast("array<string>"), "|").alias("entities"),
    )


def concentration_mixed_sizes(spark, d):
    return _mixed_sizes(spark, d)


def concentration_mixed_sizes_ranges(spark, d):
    """The same result through range partitioning."""
    return _mixed_sizes(spark, d, max_window_rows=0)


# Amounts in whole numbers (w) and units of 10 ** -15 below (b), with whole ones carried from b to w.
_UNIT = "1000000000000000"
_MIXED_SQL = f"""
WITH digits AS (SELECT *, CAST(o_custkey % 9 + 1 AS HUGEINT) AS digit, CAST(round(o_totalprice * 100) AS HUGEINT) AS cents,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'large' WHEN '2-HIGH' THEN 'small'
       WHEN '5-LOW' THEN CASE WHEN o_custkey % 3 = 0 THEN 'large' ELSE 'small' END ELSE 'plain' END AS kind FROM orders),
src AS (
  SELECT o_custkey AS entity, o_orderpriority AS period,
         CASE kind WHEN 'large' THEN digit * 100000000000000000000 WHEN 'small' THEN 0 ELSE cents // 100 END AS w,
         CASE kind WHEN 'large' THEN 0 WHEN 'small' THEN digit * 100 ELSE cents % 100 * 10000000000000 END AS b
  FROM digits
),
sums AS (
  SELECT false AS is_total, period, entity, sum(w) AS w, sum(b) AS b FROM src GROUP BY period, entity
  UNION ALL SELECT true, 'TOTAL', entity, sum(w), sum(b) FROM src GROUP BY entity
),
e AS (SELECT is_total, period, entity, w + b // {_UNIT} AS w, b % {_UNIT} AS b FROM sums),
r AS (
  SELECT *, row_number() OVER o AS rnk, sum(w) OVER (o ROWS UNBOUNDED PRECEDING) AS rw, sum(b) OVER (o ROWS UNBOUNDED PRECEDING) AS rb,
         sum(w) OVER g AS tw, sum(b) OVER g AS tb
  FROM e WINDOW o AS (PARTITION BY is_total, period ORDER BY w DESC, b DESC, entity), g AS (PARTITION BY is_total, period)
),
f AS (
  SELECT *, (rw + rb // {_UNIT}) * 100 + (rb % {_UNIT} * 100) // {_UNIT} AS hw, (rb % {_UNIT} * 100) % {_UNIT} AS hb,
         (tw + tb // {_UNIT}) * x + (tb % {_UNIT} * x) // {_UNIT} AS mw, (tb % {_UNIT} * x) % {_UNIT} AS mb
  FROM r CROSS JOIN (SELECT unnest([5, 20, 50, 99, 100]) AS x) t
),
k AS (SELECT *, hw < mw OR (hw = mw AND hb <= mb) AS ok FROM f),
s AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY is_total, period, x ORDER BY rnk) AS seen FROM k),
m AS (
  SELECT is_total, period, x AS threshold, count(*) FILTER (WHERE ok) AS n,
         CAST(coalesce(sum(w) FILTER (WHERE ok), max(w) FILTER (WHERE rnk = 1)) AS DOUBLE)
         + CAST(coalesce(sum(b) FILTER (WHERE ok), max(b) FILTER (WHERE rnk = 1)) AS DOUBLE) / 1e15 AS v,
         CAST(max(tw) AS DOUBLE) + CAST(max(tb) AS DOUBLE) / 1e15 AS total,
         string_agg(CAST(entity AS VARCHAR), '|' ORDER BY rnk) FILTER (WHERE ok AND seen <= 10) AS names,
         max(CAST(entity AS VARCHAR)) FILTER (WHERE rnk = 1) AS first_name
  FROM s GROUP BY is_total, period, x
)
SELECT is_total, period, threshold, greatest(n, 1) AS entity_count, round(v / total * 100, 6) AS pct,
       CASE WHEN n = 0 THEN first_name ELSE names END AS entities
FROM m
"""
ORACLES["concentration_mixed_sizes"] = _MIXED_SQL
ORACLES["concentration_mixed_sizes_ranges"] = _MIXED_SQL

# -- special cases -----------------------------------------------------------


def concentration_negative_values(spark, d):
    result = concentrate(table(spark, d, "customer"), "c_custkey", "c_acctbal", "c_mktsegment", [50, 95, 100])
    return report.entity_lists(result).join(metrics(result), ["is_total", "period", "threshold"])


ORACLES["concentration_negative_values"] = (
    concentration_sql("SELECT c_custkey AS entity, c_mktsegment AS period, c_acctbal AS value FROM customer", (50, 95, 100))
    + "SELECT is_total, period, threshold, entities, entity_count, round(value, 2) AS value, round(pct, 6) AS pct FROM m"
)


def concentration_negative_values_ranges(spark, d):
    result = concentrate(
        table(spark, d, "customer"), "c_custkey", "c_acctbal", "c_mktsegment", [50, 95, 100], max_window_rows=0
    )
    return report.entity_lists(result).join(metrics(result), ["is_total", "period", "threshold"])


ORACLES["concentration_negative_values_ranges"] = ORACLES["concentration_negative_values"]


def concentration_error_status(spark, d):
    """Negated balances of one segment, no entity in another: errors are rows."""
    customers = table(spark, d, "customer").select(
        "c_mktsegment",
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey")).alias("c_custkey"),
        F.when(F.col("c_mktsegment") == "MACHINERY", -F.col("c_acctbal")).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
    )
    result = concentrate(customers, "c_custkey", "c_acctbal", "c_mktsegment")
    return result.groups.select(
        "is_total", "period", "total_entities", F.round("total_value", 2).alias("total_value"), "input_rows", "status"
    )


ORACLES["concentration_error_status"] = (
    concentration_sql(
        "SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END AS entity, c_mktsegment AS period, "
        "CASE WHEN c_mktsegment = 'MACHINERY' THEN -c_acctbal ELSE c_acctbal END AS value FROM customer"
    )
    + "SELECT is_total, period, total_entities, round(CAST(total AS DOUBLE) / 1000000.0, 2) AS total_value, input_rows, status FROM gs"
)


def concentration_null_handling(spark, d):
    """Null entities, null periods and null values: each counts where it should."""
    orders = _orders(spark, d).select(
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("customer"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).otherwise(F.lit(float("nan"))).alias("price"),
    )
    result = concentrate(orders, "customer", "price", "status")
    joined = metrics(result).join(result.groups.select("is_total", "period", "total_entities", "input_rows"), ["is_total", "period"])
    return joined


ORACLES["concentration_null_handling"] = (
    concentration_sql(
        "SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS entity, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS period, "
        "CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS value FROM orders"
    )
    + "SELECT m.is_total, m.period, threshold, entity_count, round(value, 2) AS value, round(pct, 6) AS pct, total_entities, input_rows "
    "FROM m JOIN g ON m.is_total = g.is_total AND m.period = g.period"
)


def concentration_custom_thresholds(spark, d):
    return metrics(_by_priority(spark, d, [100, 1, 5, 25, 99, 25]))


ORACLES["concentration_custom_thresholds"] = concentration_sql(_PRIORITY_SOURCE, (1, 5, 25, 99, 100)) + METRICS_SQL


def threshold_entities(spark, d):
    return report.entity_lists(_by_priority(spark, d))


ORACLES["threshold_entities"] = (
    concentration_sql(_PRIORITY_SOURCE) + "SELECT is_total, period, threshold, entities FROM m"
)


def head_sample(spark, d):
    lines = table(spark, d, "lineitem").withColumn("quarter_key", quarter_of("l_shipdate"))
    head = concentrate(lines, "l_suppkey", "l_extendedprice", "quarter_key").head()
    return head.select(
        "is_total",
        "period",
        "rnk",
        "entity",
        F.round("value", 2).alias("value"),
        F.round("cumsum", 2).alias("cumsum"),
        F.round("cumulative_pct", 6).alias("cumulative_pct"),
    )


_HEAD_FIGURES = (
    "round(CAST(amount AS DOUBLE) / 1000000.0, 2) AS value, round(CAST(cumsum AS DOUBLE) / 1000000.0, 2) AS cumsum, "
    "round((CAST(cumsum AS DOUBLE) / 1000000.0) / (CAST(total AS DOUBLE) / 1000000.0) * 100, 6) AS cumulative_pct"
)
ORACLES["head_sample"] = (
    concentration_sql(_QUARTER_SOURCE) + f"SELECT is_total, period, rnk, entity, {_HEAD_FIGURES} FROM ranked WHERE rnk <= 20"
)


def period_summary(spark, d):
    return _by_priority(spark, d).summary().select("period", "entities", F.round("value", 2).alias("value"), "status")


ORACLES["period_summary"] = (
    concentration_sql(_PRIORITY_SOURCE)
    + "SELECT period, CASE WHEN status = 'ok' THEN total_entities ELSE 0 END AS entities, "
    "CASE WHEN status = 'ok' THEN round(CAST(total AS DOUBLE) / 1000000.0, 2) ELSE 0 END AS value, status FROM gs WHERE NOT is_total"
)


def analysis_overview(spark, d):
    overview = _by_priority(spark, d).overview()
    return overview.select(
        "analysis_type", "periods_analyzed", "total_input_rows", F.array_join("thresholds", "|").alias("thresholds")
    )


ORACLES["analysis_overview"] = """SELECT 'multi_period' AS analysis_type, count(DISTINCT o_orderpriority) + 1 AS periods_analyzed,
count(*) AS total_input_rows, '10|20|50' AS thresholds FROM orders"""


def distinct_periods(spark, d):
    events = table(spark, d, "events").withColumn("day_key", dates.date_key(F.col("ts")))
    return concentrate(events, "user_id", "value", "day_key").periods()


ORACLES["distinct_periods"] = "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS period FROM events ORDER BY period"


def size_warnings(spark, d):
    """Warning level lowered to 100 entities, so that the tables reach it."""
    lines = table(spark, d, "lineitem").withColumn("year_key", year_of("l_shipdate"))
    return concentrate(lines, "l_partkey", "l_quantity", "year_key").size_warnings(limit=100)


ORACLES["size_warnings"] = (
    concentration_sql("SELECT l_partkey AS entity, CAST(year(l_shipdate) AS VARCHAR) AS period, l_quantity AS value FROM lineitem")
    + "SELECT is_total, period, total_entities, 'Large dataset detected: ' || total_entities || ' entities (>100 threshold)' AS message FROM gs WHERE total_entities > 100"
)


def step_log(spark, d):
    log = _by_priority(spark, d).step_log(limit=100)
    return log.select("step", "status", "period", "entities_count", F.round("total_value", 2).alias("total_value"), "message")


ORACLES["step_log"] = (
    concentration_sql(_PRIORITY_SOURCE)
    + """SELECT 'aggregation_' || period AS step, 'completed' AS status, period, total_entities AS entities_count,
       round(CAST(total AS DOUBLE) / 1000000.0, 2) AS total_value, NULL AS message FROM gs
UNION ALL SELECT 'performance_warning_' || period, 'warning', period, total_entities, NULL,
       'Large dataset detected: ' || total_entities || ' entities (>100 threshold)' FROM gs WHERE total_entities > 100
UNION ALL SELECT 'concentration_calculation_' || period, 'completed', period, NULL, NULL, '3 thresholds calculated' FROM gs WHERE status = 'ok'
UNION ALL SELECT 'error_' || period, 'failed', period, NULL, NULL, status FROM gs WHERE status <> 'ok'
UNION ALL SELECT 'summary_generation', 'completed', NULL, NULL, NULL, count(*) || ' periods analyzed' FROM gs
UNION ALL SELECT 'period_identification', 'completed', NULL, NULL, NULL, count(*) || ' periods found: ' ||
       (SELECT string_agg(period, ', ' ORDER BY period) FROM (SELECT period FROM gs WHERE NOT is_total ORDER BY period LIMIT 10) f)
  FROM gs WHERE NOT is_total"""
)

# -- reports -----------------------------------------------------------------


def report_long(spark, d):
    return report.sorted_report(_by_priority(spark, d)).withColumn("value", F.round("value", 2))


ORACLES["report_long"] = (
    concentration_sql(_PRIORITY_SOURCE)
    + """SELECT is_total, period, threshold, entity_count AS "count", round(value, 2) AS value, round(pct, 1) AS pct_of_total,
'o_custkey' AS group_by, 'o_totalprice' AS value_column FROM m ORDER BY is_total, period, threshold"""
)


def report_total_period(spark, d):
    """A period called TOTAL stays apart from the total, in the report and in its heads."""
    named = F.when(F.col("o_orderpriority").startswith("1"), "TOTAL").otherwise(F.col("o_orderpriority"))
    result = concentrate(_orders(spark, d).withColumn("priority", named), "o_custkey", "o_totalprice", "priority")
    first = report.top_entities(result).where("rank = 1").select("is_total", "period", F.col("entity").alias("first_entity"))
    return report.long_report(result).withColumn("value", F.round("value", 2)).join(first, ["is_total", "period"])


ORACLES["report_total_period"] = (
    concentration_sql(
        "SELECT o_custkey AS entity, CASE WHEN starts_with(o_orderpriority, '1') THEN 'TOTAL' ELSE o_orderpriority END AS period, "
        "o_totalprice AS value FROM orders"
    )
    + """SELECT m.is_total, m.period, threshold, entity_count AS "count", round(value, 2) AS value, round(pct, 1) AS pct_of_total,
'o_custkey' AS group_by, 'o_totalprice' AS value_column, entity AS first_entity
FROM m JOIN ranked r ON m.is_total = r.is_total AND m.period = r.period AND rnk = 1"""
)


def report_totals_only(spark, d):
    """The report of a table without periods: one TOTAL row per threshold."""
    result = concentrate(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice")
    return report.long_report(result).withColumn("value", F.round("value", 2))


ORACLES["report_totals_only"] = (
    concentration_sql("SELECT l_suppkey AS entity, NULL AS period, l_extendedprice AS value FROM lineitem")
    + """SELECT is_total, period, threshold, entity_count AS "count", round(value, 2) AS value, round(pct, 1) AS pct_of_total,
'l_suppkey' AS group_by, 'l_extendedprice' AS value_column FROM m"""
)


def report_summary_wide(spark, d):
    wide = report.summary_wide(_by_priority(spark, d))
    return wide.select(*[F.round(c, 2).alias(c) if c == "total" or c.endswith("_value") else F.col(c) for c in wide.columns])


ORACLES["report_summary_wide"] = (
    concentration_sql(_PRIORITY_SOURCE)
    + "SELECT gs.is_total, gs.period, CASE WHEN any_value(status) = 'ok' THEN round(CAST(any_value(gs.total) AS DOUBLE) / 1000000.0, 2) ELSE 0 END AS total, "
    + ", ".join(
        f"max(entity_count) FILTER (WHERE threshold = {x}) AS top_{x}_count, "
        f"round(max(value) FILTER (WHERE threshold = {x}), 2) AS top_{x}_value, "
        f"round(max(pct) FILTER (WHERE threshold = {x}), 1) AS top_{x}_pct"
        for x in (10, 20, 50)
    )
    + " FROM gs LEFT JOIN m ON gs.is_total = m.is_total AND gs.period = m.period GROUP BY gs.is_total, gs.period"
)


def _rounded_head(frame):
    figures = {"value": 2, "cumsum": 2, "cumulative_pct": 6}
    return frame.select(*[F.round(c, figures[c]).alias(c) if c in figures else F.col(c) for c in frame.columns])


def report_top_entities(spark, d):
    return _rounded_head(report.top_entities(_by_priority(spark, d)))


ORACLES["report_top_entities"] = (
    concentration_sql(_PRIORITY_SOURCE) + f"SELECT is_total, period, rnk AS rank, entity, {_HEAD_FIGURES} FROM ranked WHERE rnk <= 10"
)


def report_details(spark, d):
    return _rounded_head(report.details(_by_priority(spark, d)))


ORACLES["report_details"] = (
    concentration_sql(_PRIORITY_SOURCE) + f"SELECT is_total, period, entity, {_HEAD_FIGURES} FROM ranked WHERE rnk <= 10"
)


def report_legacy_shape(spark, d):
    """Results rendered in the old JSON form, with either name of the share, and read back."""
    flat = _by_priority(spark, d).metrics()
    share = F.when(F.col("threshold") == 20, None).otherwise(F.col("pct"))
    other = F.when(F.col("threshold") == 20, F.col("pct"))
    entry = F.struct(
        F.concat(F.lit("top_"), F.col("threshold").cast("string")),
        F.struct(F.col("entity_count").alias("count"), "value", share.alias("percentage"), other.alias("pct_of_total")),
    )
    stored = flat.groupBy("period").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("payload"))
    return report.report_from_documents(stored, "payload").withColumn("value", F.round("value", 2))


ORACLES["report_legacy_shape"] = (
    concentration_sql(_PRIORITY_SOURCE)
    + """SELECT period, threshold, entity_count AS "count", round(value, 2) AS value, round(pct, 1) AS pct_of_total FROM m"""
)


def report_nested_shape(spark, d):
    """Stored documents as JSON text, read back as the long report."""
    documents = report.result_documents(_by_priority(spark, d)).select(
        "period", F.to_json(F.struct("period", "total_entities", "total_value", "concentration")).alias("payload")
    )
    return report.report_from_documents(documents, "payload").withColumn("value", F.round("value", 2))


ORACLES["report_nested_shape"] = ORACLES["report_legacy_shape"]


def concentration_contract(spark, d):
    """Both parts of the response form, opened to rows; a table without time has only totals."""
    periods, totals = report.contract(_by_priority(spark, d))
    opened = periods.select(
        "period", "total", F.size("head").alias("head_rows"), F.explode("concentration").alias("threshold", "f")
    )
    overall = totals.select(
        "period",
        F.col("total_value").alias("total"),
        F.lit(0).alias("head_rows"),
        F.explode("concentration").alias("threshold", "f"),
    )
    return opened.unionByName(overall).select(
        "period",
        F.round("total", 2).alias("total"),
        "head_rows",
        "threshold",
        F.col("f.count").alias("count"),
        F.round("f.value", 2).alias("value"),
        F.round("f.pct_of_total", 6).alias("pct_of_total"),
    )


ORACLES["concentration_contract"] = (
    concentration_sql(_PRIORITY_SOURCE)
    + """SELECT m.period, round(CAST(g.total AS DOUBLE) / 1000000.0, 2) AS total,
CAST(CASE WHEN m.is_total THEN 0 ELSE least(g.total_entities, 10) END AS INTEGER) AS head_rows, 'top_' || threshold AS threshold,
entity_count AS "count", round(value, 2) AS value, round(pct, 6) AS pct_of_total
FROM m JOIN g ON m.is_total = g.is_total AND m.period = g.period"""
)

# -- findings ----------------------------------------------------------------


def insight_rules(spark, d):
    orders = _orders(spark, d)
    result = concentrate(orders, "o_custkey", "o_totalprice", "o_orderpriority")
    return insight.findings(result, len(orders.columns), "date")


ORACLES["insight_rules"] = (
    concentration_sql(_PRIORITY_SOURCE)
    + """SELECT 'finding' AS kind, 'Dataset contains 6 columns with date time granularity' AS text
UNION ALL SELECT 'recommendation', 'Leverage date time series for trend analysis'
UNION ALL SELECT 'opportunity', 'Enhanced analytics available with time series'
UNION ALL SELECT 'finding', 'Top 10%: ' || entity_count || ' entities = ' || printf('%.1f', pct) || '% of value' FROM m WHERE is_total AND threshold = 10
UNION ALL SELECT 'recommendation', 'High concentration risk - consider diversification strategies' FROM m WHERE is_total AND threshold = 10 AND pct > 80"""
)


def dataset_insights(spark, d):
    """Customers as datasets: some are not described, some not analysed."""
    key = F.col("c_custkey")
    grain = F.when(key % 3 == 0, "date").when(key % 3 == 1, "none")
    schemas = (
        table(spark, d, "customer")
        .where(key % 7 > 0)
        .select(
            key.cast("string").alias("dataset_id"),
            (F.col("c_nationkey") + 1).alias("column_count"),
            grain.alias("period_grain"),
        )
    )
    orders = _orders(spark, d).where(F.col("o_custkey") % 5 > 0)
    result = concentrate(orders, "o_orderpriority", "o_totalprice", "o_custkey", [10])
    found = insight.dataset_insights(schemas, insight.analysed_datasets(result))
    lists = ["key_findings", "risk_indicators", "opportunities", "recommendations"]
    return found.select("dataset_id", "executive_summary", *[F.concat_ws("|", c).alias(c) for c in lists])


ORACLES["dataset_insights"] = (
    concentration_sql("SELECT o_orderpriority AS entity, o_custkey AS period, o_totalprice AS value FROM orders WHERE o_custkey % 5 > 0", [10])
    + """, s AS (SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, c_nationkey + 1 AS n, CASE WHEN c_custkey % 3 = 0 THEN 'date' ELSE 'none' END AS grain
FROM customer WHERE c_custkey % 7 > 0),
a AS (SELECT g.period AS dataset_id, entity_count, pct FROM gs g LEFT JOIN m ON NOT m.is_total AND g.period = m.period WHERE NOT g.is_total),
f AS (SELECT coalesce(s.dataset_id, a.dataset_id) AS dataset_id, grain, pct, a.dataset_id IS NULL AS is_pending,
CASE WHEN grain IS NOT NULL THEN 'Dataset contains ' || n || ' columns with ' || grain || ' time granularity' END AS shape,
CASE WHEN pct IS NOT NULL THEN 'Top 10%: ' || entity_count || ' entities = ' || printf('%.1f', pct) || '% of value' END AS top
FROM s FULL JOIN a ON s.dataset_id = a.dataset_id)
SELECT dataset_id,
'Analysis summary for dataset ' || dataset_id || ' with ' || CASE WHEN shape IS NOT NULL AND top IS NOT NULL THEN 2 ELSE 1 END || ' key findings' AS executive_summary,
coalesce(nullif(concat_ws('|', shape, top), ''), 'Run concentration analysis to generate detailed insights') AS key_findings,
CASE WHEN is_pending THEN 'Concentration analysis pending' ELSE '' END AS risk_indicators,
CASE WHEN grain = 'date' THEN 'Enhanced analytics available with time series' ELSE '' END AS opportunities,
concat_ws('|', CASE grain WHEN 'date' THEN 'Leverage date time series for trend analysis' WHEN 'none' THEN 'Consider adding temporal dimensions for time-based analysis' END,
CASE WHEN pct > 80 THEN 'High concentration risk - consider diversification strategies' END) AS recommendations FROM f"""
)


def risk_level(spark, d):
    """Sales by brand within part types: few entities per group, so all levels occur."""
    parts = table(spark, d, "part").withColumn("size_class", F.concat(F.lit("S"), F.col("p_size").cast("string")))
    result = concentrate(parts, "p_brand", "p_retailprice", "size_class")
    return insight.risk_levels(result).select(
        "is_total",
        "period",
        "entity_count",
        F.round("top_10_pct", 6).alias("top_10_pct"),
        "largest_entity",
        F.round("largest_pct", 6).alias("largest_pct"),
        "risk_level",
    )


ORACLES["risk_level"] = (
    concentration_sql("SELECT p_brand AS entity, 'S' || p_size AS period, p_retailprice AS value FROM part")
    + """, f AS (SELECT is_total, period, entity, CAST(amount AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS share FROM ranked WHERE rnk = 1)
SELECT m.is_total, m.period, entity_count, round(pct, 6) AS top_10_pct, entity AS largest_entity, round(share, 6) AS largest_pct,
CASE WHEN pct > 80 OR share > 20 THEN 'high' WHEN pct >= 60 THEN 'medium' ELSE 'low' END AS risk_level
FROM m JOIN f ON m.is_total = f.is_total AND m.period = f.period WHERE threshold = 10"""
)

for _name in list(ORACLES):
    QUERIES[_name] = globals()[_name]
