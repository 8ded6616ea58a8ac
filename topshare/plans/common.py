"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topshare.functions import dates
from topshare.sources.files import read_parquet


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table; ``spread`` where every row costs much and the file may be a single split."""
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", spread=spread)


def quarter_of(column: str):
    return dates.year_quarter_key(F.year(column), F.quarter(column), False, False)


def month_of(column: str):
    return dates.year_month_key(F.year(column), F.month(column), False, False)


def year_of(column: str):
    return dates.year_key(F.year(column), False)


SQL_QUARTER = "year({0}) || '-Q' || quarter({0})"
SQL_MONTH = "year({0}) || '-M' || lpad(CAST(month({0}) AS VARCHAR), 2, '0')"


def concentration_sql(source: str, thresholds=(10, 20, 50)) -> str:
    """CTEs ``e`` (sums), ``g`` (groups), ``ranked`` and ``m`` (metrics) over entity, period, value."""
    cuts = ", ".join(str(x) for x in thresholds)
    return f"""
WITH src AS (SELECT entity, period, CAST(round(value * 1000000) AS HUGEINT) AS units FROM ({source}) s0),
e AS (
  SELECT false AS is_total, CAST(period AS VARCHAR) AS period, entity, coalesce(sum(units), 0) AS amount, count(*) AS n_rows
  FROM src WHERE period IS NOT NULL GROUP BY period, entity
  UNION ALL
  SELECT true, 'TOTAL', entity, coalesce(sum(units), 0), count(*) FROM src GROUP BY entity
),
g AS (
  SELECT is_total, period, count(entity) AS total_entities, sum(amount) FILTER (WHERE entity IS NOT NULL) AS total,
         CAST(sum(n_rows) AS BIGINT) AS input_rows
  FROM e GROUP BY is_total, period
),
gs AS (
  SELECT *, CASE WHEN total_entities = 0 THEN 'No data after grouping'
                 WHEN total <= 0 THEN 'Total value is non-positive; cannot compute concentration'
                 ELSE 'ok' END AS status
  FROM g
),
ranked AS (
  SELECT e.is_total, e.period, e.entity, e.amount, g.total,
         row_number() OVER (PARTITION BY e.is_total, e.period ORDER BY e.amount DESC, e.entity ASC) AS rnk,
         sum(e.amount) OVER (PARTITION BY e.is_total, e.period ORDER BY e.amount DESC, e.entity ASC
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumsum
  FROM e JOIN g ON e.is_total = g.is_total AND e.period = g.period
  WHERE e.entity IS NOT NULL AND g.total > 0
),
flagged AS (
  SELECT r.*, t.x, (r.cumsum * 100 <= r.total * t.x) AS ok,
         count(*) FILTER (WHERE r.cumsum * 100 <= r.total * t.x)
           OVER (PARTITION BY r.is_total, r.period, t.x ORDER BY r.rnk) AS seen
  FROM ranked r CROSS JOIN (SELECT unnest([{cuts}]) AS x) t
),
m0 AS (
  SELECT is_total, period, x AS threshold, count(*) FILTER (WHERE ok) AS n, sum(amount) FILTER (WHERE ok) AS v,
         max(amount) FILTER (WHERE rnk = 1) AS first_amount, max(total) AS total,
         string_agg(CAST(entity AS VARCHAR), '|' ORDER BY rnk) FILTER (WHERE ok AND seen <= 10) AS names,
         max(CAST(entity AS VARCHAR)) FILTER (WHERE rnk = 1) AS first_name
  FROM flagged GROUP BY is_total, period, x
),
m AS (
  SELECT is_total, period, threshold, greatest(n, 1) AS entity_count,
         CAST(coalesce(v, first_amount) AS DOUBLE) / 1000000.0 AS value,
         (CAST(coalesce(v, first_amount) AS DOUBLE) / 1000000.0) / (CAST(total AS DOUBLE) / 1000000.0) * 100 AS pct,
         CASE WHEN n = 0 THEN first_name ELSE names END AS entities
  FROM m0
)
"""


METRICS_SQL = """SELECT is_total, period, threshold, entity_count, round(value, 2) AS value, round(pct, 6) AS pct FROM m"""


def metrics(result) -> DataFrame:
    return result.metrics().select(
        "is_total",
        "period",
        "threshold",
        "entity_count",
        F.round("value", 2).alias("value"),
        F.round("pct", 6).alias("pct"),
    )
