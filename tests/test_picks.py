import random

import pytest
from pyspark.sql import functions as F

from topshare.operators import sampling
from topshare.operators.picks import Pick, first_keys


def test_against_sorting(spark, rows):
    """Two keys with nulls and NaN, ties, repeated rows; every pick against a sort of its own."""
    made = random.Random(3)
    data = [(made.choice([None, float("nan"), -1.5, 0.0, 2.0, 7.5]), made.choice([None, "é", "z", "a", "A", ""]), made.choice([None, *range(9)])) for _ in range(900)]
    df = spark.createDataFrame(data + data[:50], "x double, y string, v int").repartition(7)
    v = F.col("v")
    picks = [
        Pick(4, v.isNull()),
        Pick(3, F.lit(True), v),
        Pick(6, F.col("y") != "a", v, descending=True),
        Pick(40, F.col("x").isNotNull() & (v > 2)),
        Pick(5, F.lit(False)),
        Pick(2000, F.col("y") == "z", v),
    ]
    keys = [F.col("x").asc(), F.col("y").asc()]
    parts = []
    for p in picks:
        chosen = df.where(p.among if p.by is None else p.among & p.by.isNotNull())
        order = [] if p.by is None else [p.by.desc() if p.descending else p.by.asc()]
        parts.append(chosen.orderBy(*order, *keys).limit(p.rows).select("x", "y"))
    want = parts[0]
    for part in parts[1:]:
        want = want.union(part)
    told = lambda frame: [str(r) for r in rows(frame)]
    assert sorted(told(first_keys(df, ["x", "y"], picks))) == sorted(told(want.distinct()))


def test_types_empty_tables_and_bad_keys(spark):
    df = spark.sql(
        "SELECT id, CAST(id AS DECIMAL(20, 3)) AS d, timestamp_seconds(id) AS t, date_add(DATE'2024-01-01', CAST(id AS INT)) AS day, "
        "id % 2 = 0 AS even, array(id) AS list FROM range(50)"
    )
    for column in ("d", "t", "day", "even"):
        picks = [Pick(1, F.lit(True), F.col(column), descending=True), Pick(1, F.lit(True), F.col(column))]
        assert first_keys(df, [column, "id"], picks).count() == 2
        assert first_keys(df.limit(0), [column], picks).count() == 0
    with pytest.raises(ValueError):
        first_keys(df, ["list"], [Pick(1, F.lit(True))])


def test_one_scan_finds_the_keys(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(5000).selectExpr("id", "id % 91 AS a", "id % 83 AS b", "concat('x', id % 7, '!') AS s").write.parquet(path)
    table = spark.read.parquet(path)
    plans = []
    real = sampling.materialize
    from topshare.operators import picks as module

    def watched(frame, label):
        plans.append((label, frame._jdf.queryExecution().executedPlan().toString()))
        return real(frame, label)

    monkeypatch.setattr(module, "materialize", watched)
    found = sampling.edge_cases_sample(table, ["id"], ["a", "b"], ["s"], force_nulls=False)
    assert [(label, plan.count("FileScan")) for label, plan in plans] == [("candidates", 1)]
    # Two of each end of a and b, three with special characters; 0 and 1 are among several.
    assert {r["id"] for r in found.collect()} == {0, 91, 83, 90, 181, 82, 165, 1, 2}
