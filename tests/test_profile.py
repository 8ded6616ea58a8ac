import math
import statistics

import pytest
from pyspark.sql import functions as F

from topshare.operators.normalize import normalize
from topshare.operators.profile import column_kinds, negative_policy, null_and_distinct, number_figures, outliers, profile


def by_name(frame):
    return {r["column_name"]: r.asDict() for r in frame.collect()}


def test_roles(spark):
    status = by_name(profile(spark.createDataFrame([(i % 3,) for i in range(30)], "status int")))["status"]
    assert status["role"] == "categorical" and status["cardinality"] == 3
    keys = by_name(profile(spark.createDataFrame([(i,) for i in range(100)], "transaction_id int")))["transaction_id"]
    assert keys["role"] == "numeric"
    # Half of the rows: 8 distinct of 12 is numeric although 8 > 5 would be enough too.
    half = by_name(profile(spark.createDataFrame([(float(i % 4),) for i in range(6)], "x double")))["x"]
    assert half["role"] == "numeric"


def test_nulls_flags_and_cardinality(spark):
    data = [(None if i % 4 else float(i), "a" if i % 2 else "b", float("nan") if i % 2 else 0.0 * (-1) ** (i // 2)) for i in range(104)]
    found = by_name(profile(spark.createDataFrame(data, "x double, t string, z double")))
    assert (found["x"]["null_count"], found["x"]["null_rate"], found["x"]["high_null_rate"]) == (78, 0.75, True)
    assert found["t"]["low_cardinality"] and not found["x"]["low_cardinality"]
    # NaN is null, and the two zeros are one value.
    assert (found["z"]["null_count"], found["z"]["cardinality"]) == (52, 1)


def test_approximate_mode(spark):
    df = spark.range(20000).select("id", (F.col("id") % 100).alias("k"))
    found = by_name(null_and_distinct(df, exact=False))
    assert found["k"]["cardinality"] == pytest.approx(100, rel=0.1)
    assert found["id"]["cardinality"] == pytest.approx(20000, rel=0.1)


def test_outliers_against_plain_python(spark):
    values = [float(i % 10) for i in range(200)] + [100.0, -90.0, None]
    df = spark.createDataFrame([(v, 5.0) for v in values], "x double, same double")
    found = by_name(outliers(df))
    present = [v for v in values if v is not None]
    mean, std = statistics.fmean(present), statistics.stdev(present)
    want = sum(abs(v - mean) > 3 * std for v in present)
    assert (found["x"]["outlier_count"], found["x"]["outlier_rate"]) == (want, want / len(present))
    assert found["same"]["outlier_count"] == 0
    figures = by_name(number_figures(df))["x"]
    assert math.isclose(figures["std"], std)


def test_negative_policy(spark):
    df = spark.createDataFrame(
        [(100.0, -10.0, -5.0, -1), (-50.0, 20.0, 5.0, 2), (None, 1.0, 1.0, 3)],
        "revenue double, gross_profit double, discount_amount double, other_metric int",
    )
    found = by_name(negative_policy(df))
    assert found["revenue"]["warning"] == "Unexpected negative values in 'revenue': 1 occurrences"
    assert found["revenue"]["negative_rate"] == 0.5
    assert found["gross_profit"]["warning"] is None and found["discount_amount"]["warning"] is None
    assert found["other_metric"]["warning"] is not None
    assert by_name(negative_policy(df, ["other"]))["other_metric"]["is_allowed"]


def test_table_without_numbers(spark):
    found = by_name(profile(spark.createDataFrame([("a",), (None,)], "t string")))
    assert found["t"]["null_count"] == 1 and found["t"]["mean"] is None


def test_long_texts_count_by_value(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long + "a",), (long + "b",), (long + "a",), ("short",)], "t string")
    assert null_and_distinct(df).first()["cardinality"] == 3


def test_sample_kinds(spark):
    df = spark.createDataFrame([("a", 1.0, 2023, f"k{i}") for i in range(10)], "region string, sales double, year int, key string")
    assert {r["column_name"]: r["kind"] for r in column_kinds(df).collect()} == {
        "region": "group", "sales": "value", "year": "time", "key": "other",
    }


def test_five_row_schema(spark):
    data = [("2023-01-15", "Company_A", 1000.5, "North"), ("2023-02-20", "Company_A", 1200.75, "North"), ("2023-03-10", "Company_A", 980.25, "North"),
            ("2023-01-15", "Company_B", 500.0, "South"), ("2023-02-20", "Company_B", 750.5, "South")]
    result = normalize(spark.createDataFrame(data, "date string, entity string, revenue double, region string"))
    found = by_name(profile(result.data))
    assert {n: (c["role"], c["cardinality"]) for n, c in found.items()} == {
        "date": ("datetime", 3), "entity": ("categorical", 2), "revenue": ("numeric", 5),
        "region": ("categorical", 2), "period_key": ("categorical", 3),
    }
    assert result.time.grain == "date" and result.time.candidates == ["date"] and result.warnings == []
    assert [s["step"] for s in result.transformations()] == ["header_standardization", "datetime_coercion"]


def test_plan_size_does_not_grow_with_columns(spark):
    def size(n):
        df = spark.createDataFrame([tuple(1.0 for _ in range(n))], ", ".join(f"c{i} double" for i in range(n)))
        return len(outliers(df)._jdf.queryExecution().optimizedPlan().toString())

    assert size(40) < 3 * size(10)
