"""Cleaning and time detection from one pass agree with separate passes, in any batches."""

import random

import pytest
from pyspark.sql import functions as F

from topshare.operators import normalize as nz
from topshare.operators.timekey import detect_time

WORDS = {
    "years": ["2019", "2020", " 2021 ", "2022.0", "$2,023", "1700", "x", "", "NA", None, "(2020)", "2.02k"],
    "months": ["1", "12", "13", "Jan", "march 2", "Mars", "may", None, "7.0", "0", "5%", "n/a", "$3"],
    "quarters": ["Q1", "q4", "2", "5", "Q9", None, "4.0", "third", "3%"],
    "dates": ["2023-01-05", "01/31/2024", "5 Jan 2023", "2023-13-01", "", None, "20230105", "2023-01-05 10:11:12"],
    "flags": ["true", "no", "1", "0", "YES", None, "maybe", "False"],
    "money": ["$1,234.50", "(5)", "12%", "7", "1.2k", "€3,5", "N/A", None, "abc", "99", "150"],
}
HEADERS = ["Year", "fiscal year", "Month", "Period", "Quarter", "qtr", "Order Date", "date", "Time", "Share %", "Amount", "note", "year pct"]


def random_table(spark, seed):
    rng = random.Random(seed)
    names = rng.sample(HEADERS, 6)
    pools = [rng.sample(WORDS[rng.choice(list(WORDS))], rng.randrange(1, 6)) for _ in names]
    rows = [tuple(rng.choice(p) for p in pools) for _ in range(rng.randrange(1, 60))]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


@pytest.mark.parametrize("seed", range(12))
def test_time_from_counts_is_time_from_the_cleaned_table(spark, seed):
    result = nz.normalize(random_table(spark, seed))
    assert result.time == detect_time(result.data.drop("period_key"))


def test_typed_columns(spark):
    df = spark.sql(
        "SELECT 2020 + id % 3 AS year, CAST(id % 12 + 1 AS DOUBLE) AS month, DATE '2024-01-01' AS day_date, id % 2 = 0 AS open, "
        "CAST(id AS DOUBLE) AS `rate %`, timestamp_seconds(id) AS date FROM range(30)"
    )
    result = nz.normalize(df)
    assert result.time == detect_time(result.data.drop("period_key")) and result.time.grain == "date"
    rest = nz.normalize(df.drop("date", "day_date"))
    assert rest.time.grain == "year_month" and rest.time == detect_time(rest.data.drop("period_key"))


def test_batches_do_not_matter(spark):
    df = random_table(spark, 99).unionByName(random_table(spark, 99)).repartition(3)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    found = []
    for size in ("2", "7", "10000"):
        spark.conf.set(key, size)
        found.append([tuple(r) for r in nz.cascade(df.toDF(*nz.standard_names(df.columns))).collect()])
    spark.conf.set(key, before)
    assert found[0] == found[1] == found[2]


def test_one_job_over_the_input(spark, tmp_path):
    random_table(spark, 3).write.parquet(str(tmp_path / "raw"))
    df = spark.read.parquet(str(tmp_path / "raw"))
    tracker, group = spark.sparkContext.statusTracker(), "one-pass"
    spark.sparkContext.setJobGroup(group, "cleaning")
    nz.normalize(df)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = nz.cascade(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    jobs = tracker.getJobIdsForGroup(group)
    stages = {s for j in jobs for s in tracker.getJobInfo(j).stageIds}
    # Adaptive execution runs each shuffle as a job; the input is read by one stage.
    assert len(jobs) <= 5 and len(stages) <= 9


def test_values_are_counted_not_repeated(spark):
    df = spark.range(20_000, numPartitions=2).select((F.col("id") % 3).cast("string").alias("a"), F.col("id").cast("string").alias("b"))
    found = {r["column_name"]: (r["rows"], r["n"]) for r in nz.value_counts(df).groupBy("column_name").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}
    assert found["b"] == (20_000, 20_000) and found["a"][1] == 20_000 and found["a"][0] <= 3 * 50


def test_no_rows(spark):
    with pytest.raises(ValueError):
        nz.normalize(spark.createDataFrame([], "a string, b int"))
    assert nz.normalize(spark.createDataFrame([(1,)], "b int")).data.columns == ["b", "period_key"]
