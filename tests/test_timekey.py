import datetime

import pytest
from pyspark.sql import functions as F

from topshare.functions import dates
from topshare.functions.fixed import NO_TIME
from topshare.operators.timekey import TimeSpec, detect_time, period_key, unknown_share, with_period_key


def detect(spark, schema, *data):
    return detect_time(spark.createDataFrame(list(data), schema))


@pytest.mark.parametrize(
    "schema, data, grain, columns",
    [
        ("date string, revenue int", [("2023-01-15", 1), ("2023-02-20", 2)], "date", {"date": "date"}),
        ("date date, revenue int", [(datetime.date(2023, 1, 15), 1)], "date", {"date": "date"}),
        ("year int, month int, sales int", [(2023, 1, 1), (2024, 12, 2)], "year_month", {"year": "year", "month": "month"}),
        ("year int, quarter int", [(2023, 1), (2024, 4)], "year_quarter", {"year": "year", "quarter": "quarter"}),
        ("year int, quarter string", [(2023, "Q1"), (2024, "q4")], "year_quarter", {"year": "year", "quarter": "quarter"}),
        ("year int, qtr int", [(2023, 1)], "year_quarter", {"year": "year", "quarter": "qtr"}),
        ("year int, total int", [(2020, 1), (2021, 2)], "year", {"year": "year"}),
        ("year string, total int", [("2020", 1), ("2021.0", 2)], "year", {"year": "year"}),
        ("product string, revenue int", [("A", 1)], "none", {}),
        ("date string, year int, month int", [("2023-01-15", 2023, 1)], "date", {"date": "date"}),
        ("year int, month_name string", [(2023, "January"), (2023, "Feb")], "year_month", {"year": "year", "month": "month_name"}),
        ("year int, label string", [(2023, "March"), (2023, "apr")], "year_month", {"year": "year", "month": "label"}),
        ("`année` int, mois int", [(2023, 1)], "year_month", {"year": "année", "month": "mois"}),
        ("year int", [(1800,), (2200,)], "none", {}),
        ("year int, month int", [(2023, 13), (2023, 0)], "year", {"year": "year"}),
        ("year int, quarter int", [(2023, 5), (2023, 8)], "year", {"year": "year"}),
        ("fiscal_year int", [(2023,)], "none", {}),
        ("date string", [("never",), ("2023-01-15",)], "none", {}),
        ("year double", [(None,)], "none", {}),
        ("year int, month string", [(2023, "Jan 2023")], "year_month", {"year": "year", "month": "month"}),
    ],
)
def test_detection(spark, schema, data, grain, columns):
    found = detect(spark, schema, *data)
    assert (found.grain, found.columns) == (grain, columns)
    assert (NO_TIME in found.warnings) == (grain == "none")


def test_seventy_percent(spark):
    years = [(2020,)] * 7 + [(1,)] * 3
    assert detect(spark, "year int", *years).grain == "year"
    assert detect(spark, "year int", *years[:-4], *[(1,)] * 1, *[(2,)] * 3).grain == "none"


def test_candidates_and_warning(spark):
    found = detect(spark, "date string, timestamp string, year int, month int", ("2023-01-15", "2023-01-15 10:30:00", 2023, 1))
    assert found.grain_candidates == ["date", "year_month", "year"]
    assert found.candidates == ["date", "timestamp", "year", "month"]
    assert any("Multiple date columns found" in w for w in found.warnings)


def test_empty_table_has_no_time(spark):
    assert detect_time(spark.createDataFrame([], "year int, month int")).grain == "none"


def keys(spark, schema, data, spec):
    df = spark.createDataFrame(data, schema)
    return [r[0] for r in df.select(period_key(df, spec)).collect()]


def test_keys(spark):
    assert keys(spark, "d string", [("2023-01-15",), ("03/10/2023",), ("x",), (None,)], TimeSpec("date", {"date": "d"})) == [
        "2023-01-15", "2023-03-10", "UNKNOWN", "UNKNOWN",
    ]
    ym = TimeSpec("year_month", {"year": "y", "month": "m"})
    assert keys(spark, "y int, m int", [(2023, 1), (2023, 12), (None, 1), (2024, 13)], ym) == [
        "2023-M01", "2023-M12", "UNKNOWN", "UNKNOWN",
    ]
    texts = [("2023", "January"), ("2023.0", " feb "), ("2023", "sept"), ("2023", "Jan 2023"), ("2023", "3.7"), ("x", "1")]
    assert keys(spark, "y string, m string", texts, ym) == [
        "2023-M01", "2023-M02", "UNKNOWN", "UNKNOWN", "2023-M03", "UNKNOWN",
    ]
    yq = TimeSpec("year_quarter", {"year": "y", "quarter": "q"})
    assert keys(spark, "y int, q string", [(2023, "Q1"), (2023, "4"), (2023, "q2"), (2023, "Q5"), (2023, None)], yq) == [
        "2023-Q1", "2023-Q4", "2023-Q2", "UNKNOWN", "UNKNOWN",
    ]
    assert keys(spark, "y double", [(2020.0,), (2021.9,), (None,)], TimeSpec("year", {"year": "y"})) == ["2020", "2021", "UNKNOWN"]
    assert keys(spark, "x int", [(1,), (2,)], TimeSpec()) == ["ALL", "ALL"]


def test_unknown_share(spark):
    df = with_period_key(spark.createDataFrame([(2020.0,), (None,)], "y double"), TimeSpec("year", {"year": "y"}))
    assert tuple(unknown_share(df).first()) == (2, 1, 0.5)


@pytest.mark.parametrize(
    "text, day",
    [
        ("2024-01-15", "2024-01-15"),
        ("2024-01-15T10:00:00", "2024-01-15"),
        ("2024-01", "2024-01-01"),
        ("2024", "2024-01-01"),
        ("2024/1/5", "2024-01-05"),
        ("01/15/2024", "2024-01-15"),
        ("15/01/2024", "2024-01-15"),
        ("02/03/2024 10:30", "2024-02-03"),
        ("1/5/24", "2024-01-05"),
        ("1/5/95", "1995-01-05"),
        ("15 Jan 2024", "2024-01-15"),
        ("15 january 2024", "2024-01-15"),
        ("Jan 5, 2024", "2024-01-05"),
        ("September 5, 2024", "2024-09-05"),
        ("May 2024", "2024-05-01"),
        ("March 2024", "2024-03-01"),
        ("20240115", "2024-01-15"),
        (" 2024-01-15 ", "2024-01-15"),
        ("12:30:00", None),
        ("2024-13-45", None),
        ("31/31/2024", None),
        ("hello", None),
        ("", None),
    ],
)
def test_date_texts(spark, text, day):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(dates.parse_timestamp(F.col("t")).cast("date").cast("string")).first()[0] == day
