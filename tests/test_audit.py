import datetime
import json

import pytest
from pyspark.sql import functions as F

from topshare.operators import audit
from topshare.sources import files


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


@pytest.fixture(scope="module")
def lineage(spark):
    data = [("d1", at(3), "analyze"), ("d1", at(1), "normalize"), ("d1", at(2), "normalize"), ("d1", at(4), "analyze"), ("d2", at(1), "upload")]
    return spark.createDataFrame(data, "dataset_id string, timestamp timestamp, operation string")


def test_step_numbers(lineage):
    steps = audit.numbered_steps(lineage)
    assert [(r["dataset_id"], r["id"], r["operation"]) for r in steps.orderBy("dataset_id", "step_no").collect()] == [
        ("d1", "st_0001", "normalize"), ("d1", "st_0002", "normalize"), ("d1", "st_0003", "analyze"), ("d1", "st_0004", "analyze"),
        ("d2", "st_0001", "upload"),
    ]


def test_first_and_latest(lineage):
    steps = audit.numbered_steps(lineage)
    assert [(r["dataset_id"], r["id"]) for r in audit.first_step(steps, "normalize").collect()] == [("d1", "st_0001")]
    assert [(r["dataset_id"], r["id"]) for r in audit.latest_step(steps, "analyze").collect()] == [("d1", "st_0004")]
    assert {r["dataset_id"]: r["id"] for r in audit.latest_step(steps, None).collect()} == {"d1": "st_0004", "d2": "st_0001"}


def test_normalization_summary(spark, lineage):
    schemas = spark.createDataFrame([("d1", 4), ("d2", 7)], "dataset_id string, n_columns int")
    found = audit.normalization_summary(schemas, audit.numbered_steps(lineage)).collect()
    assert [(r["dataset_id"], r["n_columns"], r["step_id"], r["normalized_at"]) for r in found] == [("d1", 4, "st_0001", at(1))]


def test_appended_step(spark, tmp_path):
    path = str(tmp_path / "lineage")
    for name in ("normalize", "analyze"):
        step = audit.lineage_step(spark.range(1), "ds", name, ["a"], ["b"], {"rows": 5}, {"warnings": 0})
        files.append_records(step, path)
    stored = files.read_json(spark, path, audit.LINEAGE_SCHEMA)
    steps = audit.numbered_steps(stored).orderBy("step_no").collect()
    assert [(s["id"], s["operation"], s["params"]) for s in steps] == [
        ("st_0001", "normalize", {"rows": "5"}), ("st_0002", "analyze", {"rows": "5"}),
    ]


@pytest.fixture(scope="module")
def artifacts(spark):
    data = [("f", f"r{i}", "d1", at(i), "m", i * 100, i % 2 == 0, "boom" if i == 3 else None) for i in range(10)]
    data.append(("g", "r99", "d2", at(5), "m", 50, False, None))
    return spark.createDataFrame(
        data, "function_name string, request_id string, dataset_id string, timestamp timestamp, model string, latency_ms bigint, cached boolean, error string"
    )


def test_usage(artifacts):
    found = {r["dataset_id"]: r for r in audit.artifact_usage(artifacts).collect()}
    d1 = found["d1"]
    assert (d1["calls_made"], d1["cached_share"], d1["failures"], d1["mean_latency_ms"], d1["max_latency_ms"], d1["limit_reached"]) == (10, 0.5, 1, 450.0, 900, True)
    assert not found["d2"]["limit_reached"]


def test_latest_artifact(artifacts):
    found = {(r["dataset_id"], r["function_name"]): r["request_id"] for r in audit.latest_artifacts(artifacts).collect()}
    assert found == {("d1", "f"): "r9", ("d2", "g"): "r99"}


GOOD = {
    "schema_description": {"column_descriptions": {"a": "b"}, "business_context": "c", "data_quality_notes": [], "recommended_analyses": []},
    "narrative_insights": {"executive_summary": "long enough text", "key_findings": ["x"], "risk_indicators": [], "opportunities": [], "recommendations": ["y"]},
    "risk_flags": {"level": "medium", "reasons": ["a"], "score": None},
    "data_quality_report": {"issues": [], "recommendations": [], "severity_score": 10},
    "threshold_recommendations": {"suggested": [10, 25, 50], "rationale": "because of the data"},
    "qa_over_context": {"answer": "x", "citations": []},
}


def violations(spark, function, **changes):
    answer = {**GOOD.get(function, {}), **changes}
    df = spark.createDataFrame([("d", function, json.dumps(answer))], "dataset_id string, function_name string, response string")
    return [r["violation"] for r in audit.artifact_violations(df).collect()]


@pytest.mark.parametrize("function", list(GOOD))
def test_good_answers(spark, function):
    assert violations(spark, function) == []


@pytest.mark.parametrize(
    "function, changes, want",
    [
        ("schema_description", {"business_context": None}, "business_context: missing"),
        ("narrative_insights", {"executive_summary": "short"}, "executive_summary: length 10..500"),
        ("narrative_insights", {"key_findings": []}, "key_findings: 1..10 entries"),
        ("narrative_insights", {"opportunities": ["x"] * 6}, "opportunities: 0..5 entries"),
        ("risk_flags", {"level": "extreme"}, "level: low, medium or high"),
        ("risk_flags", {"reasons": []}, "reasons: 1..5 entries"),
        ("risk_flags", {"score": 100.5}, "score: range 0..100"),
        ("data_quality_report", {"severity_score": 0}, "severity_score: range 1..10"),
        ("threshold_recommendations", {"suggested": [0, 10]}, "suggested: range 1..100"),
        ("threshold_recommendations", {"suggested": [10, 10]}, "suggested: unique"),
        ("threshold_recommendations", {"rationale": "r" * 301}, "rationale: length 10..300"),
        ("qa_over_context", {"answer": ""}, "answer: length 1..500"),
        ("poetry", {}, "function_name: unknown"),
    ],
)
def test_bad_answers(spark, function, changes, want):
    assert violations(spark, function, **changes) == [want]


def test_schema_validation(spark):
    column = {"name": "a", "dtype": "int", "role": "numeric", "coercions": {}}
    good = {"dataset_id": "d1", "columns": [column], "metadata": {}, "warnings": []}
    bad = {"dataset_id": "d2", "columns": [column, {"name": "b", "dtype": "int"}], "warnings": ["odd"]}
    df = spark.createDataFrame([("d1", json.dumps(good)), ("d2", json.dumps(bad))], "dataset_id string, payload string")
    counts = spark.createDataFrame([("d1", 5), ("d2", 0)], "dataset_id string, n_rows bigint")
    found = audit.validate_schemas(df, "payload", counts).collect()
    assert {tuple(r) for r in found} == {
        ("d2", "error", "Schema missing required keys: metadata"),
        ("d2", "warning", "Column 1 (b) missing keys: role, coercions"),
        ("d2", "warning", "Data quality warning: odd"),
        ("d2", "error", "Normalized data is empty or unreadable"),
    }
    assert audit.validate_schemas(df.where(F.col("dataset_id") == "d1"), "payload").count() == 0


def test_numbers_given_at_append(spark, lineage, tmp_path):
    """Appends of two sessions, one of them late in time; one that failed; null ids; an empty one."""
    path = str(tmp_path / "steps")
    with pytest.raises(ValueError):
        audit.stored_steps(spark, path)
    audit.append_steps(lineage.where("operation = 'analyze'"), path)
    # Steps without marks are those of an append that failed.
    lineage.withColumn("step_no", F.lit(99)).withColumn("id", F.lit("x")).write.parquet(f"{path}/steps/batch=lost")
    other = spark.newSession()
    again = other.createDataFrame(lineage.where("operation <> 'analyze'").collect(), lineage.schema)
    audit.append_steps(again, path, max_window_rows=0)
    audit.append_steps(lineage.limit(0), path)
    nulls = spark.createDataFrame([(None, at(9), "b"), (None, at(8), "a")], lineage.schema)
    audit.append_steps(nulls, path)
    audit.append_steps(nulls.limit(1), path)
    found = {(r["dataset_id"], r["id"], r["operation"]) for r in audit.stored_steps(spark, path).collect()}
    assert found == {
        ("d1", "st_0001", "analyze"), ("d1", "st_0002", "analyze"), ("d1", "st_0003", "normalize"), ("d1", "st_0004", "normalize"),
        ("d2", "st_0001", "upload"), (None, "st_0001", "a"), (None, "st_0002", "b"), (None, "st_0003", "b"),
    }
