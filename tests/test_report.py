import json

import pytest
from pyspark.sql import functions as F

from topshare.functions.fixed import ANALYSIS_PENDING
from topshare.operators import insight, report
from topshare.operators.concentration import concentrate


@pytest.fixture(scope="module")
def result(spark):
    data = [("P1", "A", 100.0), ("P1", "B", 50.0), ("P2", "A", 120.0), ("P2", "C", 80.0), ("P3", "D", -5.0)]
    df = spark.createDataFrame(data, "period string, entity string, revenue double")
    return concentrate(df, "entity", "revenue", "period", [50, 10, 100])


def test_long_report_order(result):
    found = report.sorted_report(result)
    assert found.columns == ["is_total", "period", "threshold", "count", "value", "pct_of_total", "group_by", "value_column"]
    assert [(r["period"], r["threshold"]) for r in found.collect()] == [
        (p, x) for p in ("P1", "P2", "TOTAL") for x in (10, 50, 100)
    ]
    assert found.first()["pct_of_total"] == 66.7


def test_wide_summary(result):
    wide = report.summary_wide(result)
    assert wide.columns == ["is_total", "period", "total"] + [
        f"top_{x}_{f}" for x in (10, 50, 100) for f in ("count", "value", "pct")
    ]
    rows = {r["period"]: r for r in wide.collect()}
    assert rows["P1"]["top_100_count"] == 2 and rows["P1"]["total"] == 150.0
    assert rows["P3"]["total"] == 0.0 and rows["P3"]["top_10_count"] is None


def test_top_entities_and_details(result):
    top = report.top_entities(result).where("period = 'P2'").orderBy("rank").collect()
    assert [(r["rank"], r["entity"], r["value"]) for r in top] == [(1, "A", 120.0), (2, "C", 80.0)]
    assert "rank" not in report.details(result).columns


def test_parameters(result):
    assert [tuple(r) for r in report.parameters(result).collect()] == [
        ("Group By", "entity"), ("Value Column", "revenue"), ("Time Column", "period"), ("Thresholds", "[10, 50, 100]"),
    ]


def test_contract(result):
    periods, totals = report.contract(result)
    found = {r["period"]: r for r in periods.collect()}
    assert set(found) == {"P1", "P2", "P3"}
    assert found["P1"]["concentration"]["top_50"].asDict() == {"count": 1, "value": 100.0, "pct_of_total": 100 / 150 * 100}
    assert [h["entity"] for h in found["P1"]["head"]] == ["A", "B"]
    assert found["P3"]["total"] == 0.0 and found["P3"]["concentration"] is None
    assert [r["period"] for r in totals.collect()] == ["TOTAL"]


def test_documents_keep_threshold_order(result):
    document = report.result_documents(result).where("period = 'P1'").select(F.to_json(F.struct("*"))).first()[0]
    stored = json.loads(document)
    assert list(stored["concentration"]) == ["top_10", "top_50", "top_100"]
    assert stored["concentration"]["top_100"]["entities"] == ["A", "B"]
    error = report.result_documents(result).where("period = 'P3'").first()
    assert error["error"].startswith("Total value is non-positive")


def test_stored_shapes(spark):
    nested = {"period": "P1", "total": 9, "concentration": {"top_10": {"count": 1, "value": 5.0, "percentage": 33.34}, "top_5": {"count": 1, "value": 2.0, "pct_of_total": 1.26}}}
    legacy = {"total": 9, "top_20": {"count": 2, "value": 7.0, "pct_of_total": 45.67, "percentage": 1.0}, "top_x": {"count": 1}, "other": 3}
    df = spark.createDataFrame([("P1", json.dumps(nested)), (None, json.dumps(legacy))], "period string, payload string")
    found = report.report_from_documents(df, "payload").collect()
    assert {tuple(r) for r in found} == {
        ("P1", 10, 1, 5.0, 33.3), ("P1", 5, 1, 2.0, 1.3), ("TOTAL", 20, 2, 7.0, 45.7), ("TOTAL", None, 1, 0.0, 0.0),
    }


def risk(spark, values):
    df = spark.createDataFrame([(f"e{i}", float(v)) for i, v in enumerate(values)], "entity string, v double")
    return insight.risk_levels(concentrate(df, "entity", "v")).first()["risk_level"]


def test_risk_levels(spark):
    assert risk(spark, [90, 10]) == "high"
    assert risk(spark, [21] + [1] * 79) == "high"
    assert risk(spark, [1] * 100) == "low"
    with pytest.raises(ValueError):
        insight.risk_levels(concentrate(spark.createDataFrame([("a", 1.0)], "e string, v double"), "e", "v", None, [20]))


def texts(frame):
    return [(r["kind"], r["text"]) for r in frame.collect()]


def test_findings(spark):
    df = spark.createDataFrame([("a", 90.0), ("b", 10.0)], "e string, v double")
    found = texts(insight.findings(concentrate(df, "e", "v"), 2, "none"))
    assert found == [
        ("finding", "Dataset contains 2 columns with none time granularity"),
        ("recommendation", "Consider adding temporal dimensions for time-based analysis"),
        ("finding", "Top 10%: 1 entities = 90.0% of value"),
        ("recommendation", "High concentration risk - consider diversification strategies"),
    ]
    without = texts(insight.findings(concentrate(df, "e", "v", None, [50])))
    assert without == [("finding", ANALYSIS_PENDING)]


def test_dataset_insights(spark):
    schemas = spark.createDataFrame([("both", 3, "year"), ("schema", 2, None), (None, 1, "year")], "dataset_id string, column_count int, period_grain string")
    analyses = spark.createDataFrame([("both", 2, 80.04), ("analysis", 1, 80.0), ("error", None, None), (None, 1, 1.0)], "dataset_id string, entity_count bigint, pct double")
    found = {r["dataset_id"]: tuple(r)[1:] for r in insight.dataset_insights(schemas, analyses).collect()}
    pending, summary = "Concentration analysis pending", "Analysis summary for dataset {} with {} key findings"
    assert found == {
        "both": (
            summary.format("both", 2), ["Dataset contains 3 columns with year time granularity", "Top 10%: 2 entities = 80.0% of value"], [],
            ["Enhanced analytics available with time series"],
            ["Leverage year time series for trend analysis", "High concentration risk - consider diversification strategies"],
        ),
        "schema": (
            summary.format("schema", 1), ["Dataset contains 2 columns with none time granularity"], [pending], [],
            ["Consider adding temporal dimensions for time-based analysis"],
        ),
        "analysis": (summary.format("analysis", 1), ["Top 10%: 1 entities = 80.0% of value"], [], [], []),
        "error": (summary.format("error", 1), [ANALYSIS_PENDING], [], [], []),
    }


def test_insights_look_up_the_grain(spark):
    df = spark.createDataFrame([("a", 9.0, 2021), ("b", 1.0, 2022)], "e string, v double, year int")
    pending = insight.insights_of(df, "d").first()
    assert pending["key_findings"] == ["Dataset contains 3 columns with year time granularity"]
    assert pending["risk_indicators"] == ["Concentration analysis pending"]
    full = insight.insights_of(df, "d", concentrate(df, "e", "v")).first()
    assert full["executive_summary"].endswith("with 2 key findings") and full["risk_indicators"] == []
    assert full["recommendations"][1].startswith("High concentration risk")
