import pytest

from topshare.operators import audit
from topshare.operators.dataset import column_schema, normalize_and_store, schema_document
from topshare.operators.normalize import normalize
from topshare.sources import files

FIVE_ROWS = [
    ("2023-01-15", "Company_A", "1000.50", "North"),
    ("2023-02-20", "Company_A", "1200.75", "North"),
    ("2023-03-10", "Company_A", "980.25", "North"),
    ("2023-01-15", "Company_B", "500.00", "South"),
    ("2023-02-20", "Company_B", "750.50", "South"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(FIVE_ROWS, "date string, entity string, revenue string, region string")


def test_five_rows(raw):
    result = normalize(raw)
    found = {r["name"]: r for r in column_schema(result.data, result).collect()}
    assert {n: (r["dtype"], r["role"], r["cardinality"]) for n, r in found.items()} == {
        "date": ("timestamp", "datetime", 3),
        "entity": ("string", "categorical", 2),
        "revenue": ("double", "numeric", 5),
        "region": ("string", "categorical", 2),
        "period_key": ("string", "categorical", 3),
    }
    assert found["date"]["coercions"].asDict() == {
        "currency_removed": 0, "parentheses_to_negative": 0, "scaling_applied": 0, "unicode_minus_normalized": 0,
        "percent_normalized": 0, "datetime_parsed": 5, "boolean_coerced": 0, "failed_numeric_coercions": 0,
    }
    document = schema_document(result.data, result, "ds").first()
    assert [c["name"] for c in document["columns"]] == ["date", "entity", "revenue", "region", "period_key"]
    assert document["metadata"].asDict() == {
        "row_count": 5, "column_count": 5, "multi_currency": False, "currencies_detected": [], "has_time_dimension": True,
    }
    assert (document["period_grain"], document["period_grain_candidates"], document["time_candidates"]) == ("date", ["date"], ["date"])
    assert document["transformations_summary"].asDict() == {
        "total_transformations": 2, "columns_modified": 1, "transformation_types": ["datetime_coercion", "header_standardization"],
    }
    assert document["warnings"] == []


def test_warnings_and_currencies(spark):
    df = spark.createDataFrame([("$100", "(1,5)"), ("€50", "2.345,67"), ("-$75", "1,234.56")], "Revenue string, Cost string")
    result = normalize(df)
    document = schema_document(result.data, result, "ds").first()
    assert document["metadata"]["currencies_detected"] == ["$", "€"] and document["metadata"]["multi_currency"]
    assert document["warnings"] == [
        "Column 'cost' contains mixed decimal conventions (both US and EU formats)",
        "No temporal dimension detected",
        "Unexpected negative values in 'revenue': 1 occurrences",
    ]


def test_stored(spark, raw, tmp_path, rows):
    path = str(tmp_path)
    for name in ("d1", "d2"):
        data = normalize_and_store(raw, name, path)
    assert rows(data, "entity", "revenue", "period_key")[0] == ("Company_A", 1000.5, "2023-01-15")
    steps = audit.numbered_steps(files.read_json(spark, f"{path}/lineage", audit.LINEAGE_SCHEMA))
    assert {(r["dataset_id"], r["id"], r["operation"]) for r in steps.collect()} == {("d1", "st_0001", "normalize"), ("d2", "st_0001", "normalize")}
    stored = spark.read.text(f"{path}/schema/dataset_id=d1").selectExpr("'d1' as dataset_id", "value as payload")
    assert audit.validate_schemas(stored, "payload").count() == 0
