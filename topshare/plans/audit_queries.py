"""Lineage, artifacts and stored metadata, made from events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from topshare.operators import audit
from topshare.plans.common import table
from topshare.session import scratch_path

QUERIES, ORACLES = {}, {}

# -- lineage: users are datasets, event types are operations ------------------------


def _lineage(spark, d):
    return table(spark, d, "events").select(
        F.concat(F.lit("ds_"), F.col("user_id").cast("string")).alias("dataset_id"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") == "view", "normalize").otherwise(F.col("event_type")).alias("operation"),
        "event_id",
        F.create_map(F.lit("value"), F.col("value").cast("string")).alias("params"),
    )


_STEPS = """(SELECT 'ds_' || user_id AS dataset_id, CASE WHEN event_type = 'view' THEN 'normalize' ELSE event_type END AS operation, event_id,
row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_no FROM events)"""
_ID = "'st_' || lpad(CAST(step_no AS VARCHAR), CAST(greatest(4, length(CAST(step_no AS VARCHAR))) AS INTEGER), '0')"


def lineage_steps(spark, d):
    steps = audit.numbered_steps(_lineage(spark, d), ["event_id"])
    return steps.select("dataset_id", "step_no", "id", "operation", "event_id")


ORACLES["lineage_steps"] = f"SELECT dataset_id, step_no, {_ID} AS id, operation, event_id FROM {_STEPS} s"


def lineage_steps_ranges(spark, d):
    """The same numbers by range partitioning, the way for datasets of any size."""
    steps = audit.numbered_steps(_lineage(spark, d), ["event_id"], max_window_rows=0)
    return steps.select("dataset_id", "step_no", "id", "operation", "event_id")


ORACLES["lineage_steps_ranges"] = ORACLES["lineage_steps"]


def lineage_appended(spark, d):
    """Steps stored by two sessions, one after the other: numbers go on where the first ended."""
    steps, path = _lineage(spark, d), scratch_path(spark, "lineage")
    late = F.col("event_id") % 3 == 0
    audit.append_steps(steps.where(~late), path, ["event_id"])
    audit.append_steps(_lineage(spark.newSession(), d).where(late), path, ["event_id"], max_window_rows=0)
    return audit.stored_steps(spark, path).select("dataset_id", "step_no", "id", "operation", "event_id")


ORACLES["lineage_appended"] = ORACLES["lineage_steps"].replace("ORDER BY ts", "ORDER BY event_id % 3 = 0, ts")


def lineage_latest(spark, d):
    steps = audit.numbered_steps(_lineage(spark, d), ["event_id"])
    return audit.latest_step(steps, "purchase").select("dataset_id", "id", "operation", "event_id")


ORACLES["lineage_latest"] = f"""SELECT dataset_id, {_ID} AS id, operation, event_id FROM {_STEPS} s WHERE operation = 'purchase'
QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY step_no DESC) = 1"""


def lineage_first(spark, d):
    steps = audit.numbered_steps(_lineage(spark, d), ["event_id"])
    return audit.first_step(steps, "normalize").select("dataset_id", "id", "operation", "event_id")


ORACLES["lineage_first"] = f"""SELECT dataset_id, {_ID} AS id, operation, event_id FROM {_STEPS} s WHERE operation = 'normalize'
QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY step_no) = 1"""


def normalization_summary(spark, d):
    """One schema per user, joined to the user's first normalize step."""
    schemas = (
        table(spark, d, "events")
        .groupBy(F.concat(F.lit("ds_"), F.col("user_id").cast("string")).alias("dataset_id"))
        .agg(F.countDistinct("event_type").alias("column_count"), F.count(F.lit(1)).alias("row_count"))
    )
    steps = audit.numbered_steps(_lineage(spark, d), ["event_id"])
    summary = audit.normalization_summary(schemas, steps)
    return summary.select("dataset_id", "column_count", "row_count", "step_id", "event_id")


ORACLES["normalization_summary"] = f"""SELECT s.dataset_id, e.column_count, e.row_count, {_ID} AS step_id, s.event_id FROM {_STEPS} s
JOIN (SELECT 'ds_' || user_id AS dataset_id, count(DISTINCT event_type) AS column_count, count(*) AS row_count FROM events GROUP BY 1) e
ON s.dataset_id = e.dataset_id WHERE operation = 'normalize'
QUALIFY row_number() OVER (PARTITION BY s.dataset_id ORDER BY step_no) = 1"""

# -- artifacts: events as stored model calls ---------------------------------------


def _artifacts(spark, d):
    return table(spark, d, "events").select(
        F.col("event_type").alias("function_name"),
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("ds_"), F.col("user_id").cast("string")).alias("dataset_id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"),
        F.floor(F.col("value") * 100).alias("latency_ms"),
        (F.get_json_object("props", "$.k").cast("int") % 4 == 0).alias("cached"),
        F.when(F.col("event_id") % 13 == 0, F.lit("timeout")).alias("error"),
    )


_USAGE = """count(*) AS calls_made, round(avg(CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 = 0 THEN 1.0 ELSE 0.0 END), 9) AS cached_share,
count(*) FILTER (WHERE event_id % 13 = 0) AS failures, round(avg(CAST(floor(value * 100) AS BIGINT)), 6) AS mean_latency_ms,
max(CAST(floor(value * 100) AS BIGINT)) AS max_latency_ms, CAST(10 AS BIGINT) AS max_calls, count(*) >= 10 AS limit_reached FROM events"""


def _usage(frame):
    return frame.withColumn("cached_share", F.round("cached_share", 9)).withColumn(
        "mean_latency_ms", F.round("mean_latency_ms", 6)
    )


def artifact_usage(spark, d):
    return _usage(audit.artifact_usage(_artifacts(spark, d)))


ORACLES["artifact_usage"] = f"SELECT 'ds_' || user_id AS dataset_id, {_USAGE} GROUP BY user_id"


def usage_overview(spark, d):
    return audit.usage_overview(_artifacts(spark, d))


ORACLES["usage_overview"] = """SELECT count(DISTINCT user_id) AS total_datasets, count(*) AS total_calls,
count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 = 0) AS cached_calls FROM events"""


def artifact_usage_by_function(spark, d):
    return _usage(audit.artifact_usage(_artifacts(spark, d), ["function_name", "model"]))


ORACLES["artifact_usage_by_function"] = (
    f"SELECT event_type AS function_name, 'm' || (event_id % 3) AS model, {_USAGE} GROUP BY 1, 2"
)


def artifact_latest(spark, d):
    return audit.latest_artifacts(_artifacts(spark, d)).select(
        "dataset_id", "function_name", "request_id", "model", "latency_ms", "error"
    )


ORACLES["artifact_latest"] = """SELECT 'ds_' || user_id AS dataset_id, event_type AS function_name, event_id AS request_id,
'm' || (event_id % 3) AS model, CAST(floor(value * 100) AS BIGINT) AS latency_ms, CASE WHEN event_id % 13 = 0 THEN 'timeout' END AS error
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""


def artifact_violations(spark, d):
    """Documents as answers of all six functions and an unknown one, with lists and texts of any length."""
    key = F.col("doc_id")
    repeat = lambda n: F.array_repeat(F.col("source"), n.cast("int"))
    function = (
        F.when(key % 7 == 0, "risk_flags")
        .when(key % 7 == 1, "threshold_recommendations")
        .when(key % 7 == 2, "qa_over_context")
        .when(key % 7 == 3, "data_quality_report")
        .when(key % 7 == 5, "narrative_insights")
        .when(key % 7 == 6, "schema_description")
        .otherwise("free_text")
    )
    is_a = lambda i: key % 7 == i
    answer = F.struct(
        F.when(is_a(0) & (key % 3 > 0), F.when(F.col("lang") == "en", "low").otherwise("severe")).alias("level"),
        F.when(is_a(0), repeat(key % 8)).alias("reasons"),
        F.when(is_a(0), F.col("n_chars") / 50.0).alias("score"),
        F.when(is_a(1), F.array((key % 120).cast("int"), F.lit(10), (key % 6 * 10).cast("int"))).alias("suggested"),
        F.when(is_a(1), F.col("text")).alias("rationale"),
        F.when(is_a(2), F.col("text")).alias("answer"),
        F.when(is_a(2) & (key % 4 > 0), repeat(key % 9)).alias("citations"),
        F.when(is_a(3), repeat(key % 13)).alias("issues"),
        F.when(is_a(3) | (is_a(5) & (key % 6 > 0)), repeat(key % 11)).alias("recommendations"),
        F.when(is_a(3), (key % 15).cast("int")).alias("severity_score"),
        F.when(is_a(5) & (key % 3 > 0), F.col("text")).alias("executive_summary"),
        F.when(is_a(5), repeat(key % 12)).alias("key_findings"),
        F.when(is_a(5), repeat(key % 8)).alias("risk_indicators"),
        F.when(is_a(5) & (key % 4 > 0), repeat(key % 9)).alias("opportunities"),
        F.when(is_a(6) & (key % 3 > 0), F.create_map(F.lit("doc_id"), F.col("source"))).alias("column_descriptions"),
        F.when(is_a(6) & (key % 4 > 0), F.col("source")).alias("business_context"),
        F.when(is_a(6) & (key % 5 > 0), repeat(key % 4)).alias("data_quality_notes"),
        F.when(is_a(6) & (key % 6 > 0), repeat(key % 4)).alias("recommended_analyses"),
    )
    artifacts = table(spark, d, "documents").select(
        "doc_id", function.alias("function_name"), F.to_json(answer).alias("response")
    )
    return audit.artifact_violations(artifacts, ["doc_id", "function_name"])


_RULES = [
    ("risk_flags", "level: missing", "doc_id % 7 = 0 AND doc_id % 3 = 0"),
    ("risk_flags", "level: low, medium or high", "doc_id % 7 = 0 AND doc_id % 3 > 0 AND lang <> 'en'"),
    ("risk_flags", "reasons: 1..5 entries", "doc_id % 7 = 0 AND doc_id % 8 NOT BETWEEN 1 AND 5"),
    ("risk_flags", "score: range 0..100", "doc_id % 7 = 0 AND n_chars / 50.0 > 100"),
    ("threshold_recommendations", "suggested: range 1..100", "doc_id % 7 = 1 AND (doc_id % 120 NOT BETWEEN 1 AND 100 OR doc_id % 6 = 0)"),
    (
        "threshold_recommendations",
        "suggested: unique",
        "doc_id % 7 = 1 AND (doc_id % 120 = 10 OR doc_id % 6 * 10 = 10 OR doc_id % 120 = doc_id % 6 * 10)",
    ),
    ("threshold_recommendations", "rationale: length 10..300", "doc_id % 7 = 1 AND length(text) NOT BETWEEN 10 AND 300"),
    ("qa_over_context", "answer: length 1..500", "doc_id % 7 = 2 AND length(text) NOT BETWEEN 1 AND 500"),
    ("qa_over_context", "citations: missing", "doc_id % 7 = 2 AND doc_id % 4 = 0"),
    ("qa_over_context", "citations: 0..5 entries", "doc_id % 7 = 2 AND doc_id % 4 > 0 AND doc_id % 9 > 5"),
    ("data_quality_report", "issues: 0..10 entries", "doc_id % 7 = 3 AND doc_id % 13 > 10"),
    ("data_quality_report", "severity_score: range 1..10", "doc_id % 7 = 3 AND doc_id % 15 NOT BETWEEN 1 AND 10"),
    ("narrative_insights", "executive_summary: missing", "doc_id % 7 = 5 AND doc_id % 3 = 0"),
    (
        "narrative_insights",
        "executive_summary: length 10..500",
        "doc_id % 7 = 5 AND doc_id % 3 > 0 AND length(text) NOT BETWEEN 10 AND 500",
    ),
    ("narrative_insights", "key_findings: 1..10 entries", "doc_id % 7 = 5 AND doc_id % 12 NOT BETWEEN 1 AND 10"),
    ("narrative_insights", "risk_indicators: 0..5 entries", "doc_id % 7 = 5 AND doc_id % 8 > 5"),
    ("narrative_insights", "opportunities: missing", "doc_id % 7 = 5 AND doc_id % 4 = 0"),
    ("narrative_insights", "opportunities: 0..5 entries", "doc_id % 7 = 5 AND doc_id % 4 > 0 AND doc_id % 9 > 5"),
    ("narrative_insights", "recommendations: missing", "doc_id % 7 = 5 AND doc_id % 6 = 0"),
    (
        "narrative_insights",
        "recommendations: 1..5 entries",
        "doc_id % 7 = 5 AND doc_id % 6 > 0 AND doc_id % 11 NOT BETWEEN 1 AND 5",
    ),
    ("schema_description", "column_descriptions: missing", "doc_id % 7 = 6 AND doc_id % 3 = 0"),
    ("schema_description", "business_context: missing", "doc_id % 7 = 6 AND doc_id % 4 = 0"),
    ("schema_description", "data_quality_notes: missing", "doc_id % 7 = 6 AND doc_id % 5 = 0"),
    ("schema_description", "recommended_analyses: missing", "doc_id % 7 = 6 AND doc_id % 6 = 0"),
    ("free_text", "function_name: unknown", "doc_id % 7 = 4"),
]
ORACLES["artifact_violations"] = " UNION ALL ".join(
    f"SELECT doc_id, '{f}' AS function_name, '{text}' AS violation FROM documents WHERE {cond}" for f, text, cond in _RULES
)

# -- stored schemas ---------------------------------------------------------------------


def _stored_schemas(spark, d):
    """One stored schema per document; keys are missing by rule, and so are tables."""
    key = F.col("doc_id")
    column = F.struct(
        F.col("lang").alias("name"),
        F.lit("string").alias("dtype"),
        F.when(key % 4 > 0, "categorical").alias("role"),
        F.when(key % 6 > 0, F.struct(F.lit(0).alias("currency_removed"))).alias("coercions"),
    )
    payload = F.struct(
        key.cast("string").alias("dataset_id"),
        F.when(key % 10 > 0, F.array(column, column)).alias("columns"),
        F.when(key % 3 > 0, F.struct(F.col("n_chars").alias("row_count"))).alias("metadata"),
        F.when(key % 5 > 0, F.filter(F.array(F.when(key % 7 == 0, F.col("source"))), lambda s: s.isNotNull())).alias("warnings"),
    )
    documents = table(spark, d, "documents").select("doc_id", key.alias("dataset_id"), F.to_json(payload).alias("payload"))
    labels = table(spark, d, "labels").groupBy(F.col("doc_id").alias("dataset_id")).agg(F.count(F.lit(1)).alias("n_rows"))
    return documents, "payload", labels


def artifact_validation(spark, d):
    return audit.validate_schemas(*_stored_schemas(spark, d))


_GAPS = "array_to_string(list_filter([CASE WHEN doc_id % 4 = 0 THEN 'role' END, CASE WHEN doc_id % 6 = 0 THEN 'coercions' END], lambda x: x IS NOT NULL), ', ')"
_MISSING = "array_to_string(list_filter([CASE WHEN doc_id % 10 = 0 THEN 'columns' END, CASE WHEN doc_id % 3 = 0 THEN 'metadata' END, CASE WHEN doc_id % 5 = 0 THEN 'warnings' END], lambda x: x IS NOT NULL), ', ')"
ORACLES["artifact_validation"] = f"""SELECT doc_id AS dataset_id, 'error' AS severity, 'Schema missing required keys: ' || {_MISSING} AS message FROM documents
WHERE doc_id % 10 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0
UNION ALL SELECT doc_id, 'warning', 'Column ' || i || ' (' || lang || ') missing keys: ' || {_GAPS} FROM documents, (SELECT unnest([0, 1]) AS i) c
WHERE doc_id % 10 > 0 AND (doc_id % 4 = 0 OR doc_id % 6 = 0)
UNION ALL SELECT doc_id, 'warning', 'Data quality warning: ' || source FROM documents WHERE doc_id % 5 > 0 AND doc_id % 7 = 0
UNION ALL SELECT doc_id, 'error', 'Normalized data is empty or unreadable' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""



def artifact_verdicts(spark, d):
    """Whether each stored schema is valid, with its counts of errors and warnings."""
    return audit.schema_verdicts(*_stored_schemas(spark, d))


ORACLES["artifact_verdicts"] = f"""WITH found AS ({ORACLES["artifact_validation"]})
SELECT d.doc_id AS dataset_id, count(*) FILTER (WHERE severity = 'error') = 0 AS is_valid,
count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings
FROM documents d LEFT JOIN found f ON d.doc_id = f.dataset_id GROUP BY d.doc_id"""

for _name in list(ORACLES):
    QUERIES[_name] = globals()[_name]
