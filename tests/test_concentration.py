import random

import pytest
from pyspark.sql import functions as F

from topshare.functions.fixed import EMPTY_GROUP, NON_POSITIVE
from topshare.operators.concentration import check_thresholds, concentrate

FIVE_ROWS = [
    ("2023-01-15", "Company_A", 1000.50, "North"),
    ("2023-02-20", "Company_A", 1200.75, "North"),
    ("2023-03-10", "Company_A", 980.25, "North"),
    ("2023-01-15", "Company_B", 500.00, "South"),
    ("2023-02-20", "Company_B", 750.50, "South"),
]


def frame(spark, values, period=False):
    schema = "period string, entity string, revenue double" if period else "entity string, revenue double"
    return spark.createDataFrame(values, schema)


def figures(result, period="TOTAL"):
    found = result.metrics().where(F.col("period") == period).orderBy("threshold").collect()
    return {r["threshold"]: (r["entity_count"], r["value"], r["pct"], list(r["entities"])) for r in found}


@pytest.fixture(params=[500_000, 0], ids=["window", "ranges"])
def limit(request):
    return request.param


def test_five_rows(spark, limit):
    df = spark.createDataFrame(FIVE_ROWS, "date string, entity string, revenue double, region string")
    result = concentrate(df, "entity", "revenue", "date", [50, 75], max_window_rows=limit)
    assert figures(result, "2023-01-15") == {x: (1, 1000.5, 66.67777407530822, ["Company_A"]) for x in (50, 75)}
    assert figures(result, "2023-02-20")[50][2] == 61.53747597693786
    assert figures(result, "2023-03-10")[50] == (1, 980.25, 100.0, ["Company_A"])
    assert figures(result) == {x: (1, 3181.5, 71.78474729241877, ["Company_A"]) for x in (50, 75)}
    groups = {r["period"]: (r["total_entities"], r["total_value"]) for r in result.groups.collect()}
    assert groups == {"2023-01-15": (2, 1500.5), "2023-02-20": (2, 1951.25), "2023-03-10": (1, 980.25), "TOTAL": (2, 4432.0)}
    overview = result.overview().first()
    assert (overview["analysis_type"], overview["periods_analyzed"], overview["total_input_rows"]) == ("multi_period", 4, 5)
    head = result.head().where("is_total").orderBy("rnk").collect()
    assert [(r["entity"], r["value"], r["cumsum"], r["cumulative_pct"]) for r in head] == [
        ("Company_A", 3181.5, 3181.5, 71.78474729241877),
        ("Company_B", 1250.5, 4432.0, 100.0),
    ]


def test_ties_go_by_name(spark, limit):
    result = concentrate(frame(spark, [("B", 100.0), ("A", 100.0), ("C", 50.0)]), "entity", "revenue", max_window_rows=limit)
    assert [r["entity"] for r in result.head().orderBy("rnk").collect()] == ["A", "B", "C"]


def test_fifty_ties(spark, limit):
    values = [(f"Entity_{i:02d}", 100.0) for i in reversed(range(50))]
    result = concentrate(frame(spark, values), "entity", "revenue", None, [10, 20, 50], max_window_rows=limit)
    found = figures(result)
    assert {x: found[x][0] for x in found} == {10: 5, 20: 10, 50: 25}
    assert found[50][3] == [f"Entity_{i:02d}" for i in range(10)]


def test_total_ranks_sums_over_periods(spark, limit):
    values = [("Q1", "A", 100.0), ("Q1", "B", 50.0), ("Q2", "A", 120.0), ("Q2", "C", 80.0)]
    result = concentrate(frame(spark, values, True), "entity", "revenue", "period", max_window_rows=limit)
    assert {r["period"]: r["total_value"] for r in result.groups.collect()} == {"Q1": 150.0, "Q2": 200.0, "TOTAL": 350.0}
    assert [r["entity"] for r in result.head().where("is_total").orderBy("rnk").collect()] == ["A", "C", "B"]


def test_zero_and_negative(spark, limit):
    values = [("A", 100.0), ("B", 0.0), ("C", -20.0), ("D", 50.0)]
    result = concentrate(frame(spark, values), "entity", "revenue", max_window_rows=limit)
    assert result.groups.first()["total_value"] == 130.0
    assert [r["entity"] for r in result.head().orderBy("rnk").collect()] == ["A", "D", "B", "C"]


def test_qualifying_rows_are_not_a_prefix(spark, limit):
    values = [("A", 100.0), ("B", 50.0), ("C", 0.0), ("D", -20.0)]
    result = concentrate(frame(spark, values), "entity", "revenue", None, [100], max_window_rows=limit)
    assert figures(result)[100] == (2, 80.0, 80.0 / 130.0 * 100, ["A", "D"])


def test_many_negatives_list_names_after_the_gap(spark, limit):
    values = [("top", 1000.0)] + [(f"m{i:02d}", 100.0) for i in range(30)] + [(f"n{i:02d}", -100.0) for i in range(30)]
    result = concentrate(
        frame(spark, values), "entity", "revenue", None, [100], max_window_rows=limit, rows_per_range=5
    )
    # 1000 is all of the total; the shares pass 100 and only the very last row brings it back.
    assert figures(result)[100] == (2, 900.0, 90.0, ["top", "n29"])


@pytest.mark.parametrize("values", [[-100.0, -50.0, -25.0], [100.0, 50.0, -75.0, -75.0]])
def test_non_positive_total(spark, values, limit):
    data = [(chr(65 + i), v) for i, v in enumerate(values)]
    result = concentrate(frame(spark, data), "entity", "revenue", max_window_rows=limit)
    assert result.groups.first()["status"] == NON_POSITIVE
    assert result.metrics().count() == result.head().count() == 0


def test_bad_period_leaves_the_others(spark, limit):
    values = [("P1", "A", 10.0), ("P2", "A", -1.0), ("P3", None, 5.0)]
    result = concentrate(frame(spark, values, True), "entity", "revenue", "period", max_window_rows=limit)
    assert {r["period"]: r["status"] for r in result.groups.collect()} == {
        "P1": "ok", "P2": NON_POSITIVE, "P3": EMPTY_GROUP, "TOTAL": "ok",
    }
    assert {r["period"] for r in result.metrics().collect()} == {"P1", "TOTAL"}
    assert {(r["period"], r["entities"], r["value"]) for r in result.summary().collect()} == {
        ("P1", 1, 10.0), ("P2", 0, 0.0), ("P3", 0, 0.0),
    }


def test_empty_input_is_a_status_row(spark, limit):
    result = concentrate(frame(spark, [], True), "entity", "revenue", "period", max_window_rows=limit)
    row = result.groups.collect()
    assert [(r["period"], r["status"], r["input_rows"]) for r in row] == [("TOTAL", EMPTY_GROUP, 0)]


def test_nulls_and_nan(spark):
    values = [("P", "A", 10.0), ("P", "A", float("nan")), ("P", "B", None), (None, "C", 5.0), ("P", None, 100.0)]
    result = concentrate(frame(spark, values, True), "entity", "revenue", "period")
    found = {r["period"]: (r["total_entities"], r["total_value"], r["input_rows"]) for r in result.groups.collect()}
    assert found == {"P": (2, 10.0, 4), "TOTAL": (3, 15.0, 5)}


def test_period_called_total_stays_apart(spark):
    values = [("TOTAL", "A", 1.0), ("X", "A", 2.0)]
    result = concentrate(frame(spark, values, True), "entity", "revenue", "period")
    assert {(r["is_total"], r["period"], r["total_value"]) for r in result.groups.collect()} == {
        (False, "TOTAL", 1.0), (False, "X", 2.0), (True, "TOTAL", 3.0),
    }


def test_tiny_and_large_totals(spark):
    tiny = concentrate(frame(spark, [("A", 0.001), ("B", 0.0005), ("C", 0.0003)]), "entity", "revenue")
    assert tiny.groups.first()["total_value"] == 0.0018
    assert tiny.places == 6
    fine = concentrate(frame(spark, [("A", 3.4e-6), ("B", 1e-6)]), "entity", "revenue")
    assert [(r["entity_count"], r["value"]) for r in fine.metrics().collect()] == [(1, 3.4e-6)] * 3
    below = concentrate(frame(spark, [("A", 3e-7), ("B", 1e-7)]), "entity", "revenue")
    group = below.groups.first()
    assert (group["status"], group["total_value"]) == ("ok", pytest.approx(4e-7))
    assert [r["value"] for r in below.head().orderBy("rnk").collect()] == pytest.approx([3e-7, 1e-7])
    huge = concentrate(frame(spark, [("A", 3e23), ("B", 1e23)]), "entity", "revenue", None, [90])
    assert figures(huge)[90][0] == 1 and huge.groups.first()["total_value"] == 4e23
    large = concentrate(frame(spark, [("A", 4e17), ("B", 123456789012.34), ("A", 1e17)]), "entity", "revenue")
    assert dict(large.ranked.dtypes)["amount"] == "decimal(38,0)"
    assert large.head().orderBy("rnk").first()["value"] == 5e17
    assert large.head().where("entity = 'B'").first()["value"] == 123456789012.34


def test_extreme_thresholds(spark):
    values = [("A", 1000.0), ("B", 100.0), ("C", 50.0), ("D", 10.0)]
    found = figures(concentrate(frame(spark, values), "entity", "revenue", None, [1, 99]))
    # 1000/1160 = 86%, 1100/1160 = 95%, 1150/1160 = 99.1%
    assert (found[1][0], found[99][0]) == (1, 2)


def test_threshold_100_takes_all(spark):
    values = [("A", 500.0), ("B", 300.0), ("C", 150.0), ("D", 75.0), ("E", 25.0)]
    found = figures(concentrate(frame(spark, values), "entity", "revenue", None, [25, 50, 100]))
    assert {x: (found[x][0], found[x][1]) for x in found} == {25: (1, 500.0), 50: (1, 500.0), 100: (5, 1050.0)}


def test_decimal_cut_is_exact(spark):
    # Ten times 0.1 is exactly the total: as doubles the last share can pass 100.
    values = [(f"E{i}", 0.1) for i in range(10)]
    found = figures(concentrate(frame(spark, values), "entity", "revenue", None, [10, 30, 70, 100]))
    assert {x: found[x][0] for x in found} == {10: 1, 30: 3, 70: 7, 100: 10}


def test_integer_and_decimal_measures(spark):
    df = frame(spark, [("A", 7.0), ("B", 3.0)])
    for data_type in ("int", "bigint", "float", "decimal(10,2)"):
        result = concentrate(df.withColumn("revenue", F.col("revenue").cast(data_type)), "entity", "revenue", None, [70])
        assert figures(result)[70] == (1, 7.0, 70.0, ["A"])


@pytest.mark.parametrize("bad", [[], [0], [101], list(range(1, 12)), [10.5], [True]])
def test_bad_thresholds(bad):
    with pytest.raises(ValueError):
        check_thresholds(bad)


def test_thresholds_are_sorted_and_distinct():
    assert check_thresholds([50, 10, 50]) == [10, 50]
    assert check_thresholds(None) == [10, 20, 50]


@pytest.mark.parametrize("arguments", [("nobody", "revenue"), ("entity", "nothing"), ("entity", "revenue", "when"), ("revenue", "entity")])
def test_bad_columns(spark, arguments):
    with pytest.raises(ValueError):
        concentrate(frame(spark, [("A", 1.0)]), *arguments)


def test_window_and_ranges_agree_whatever_the_partitioning(spark, rows):
    rng = random.Random(7)
    values = [(f"p{rng.randrange(3)}", f"e{rng.randrange(400):03d}", round(rng.expovariate(0.01) - 20, 2)) for _ in range(5000)]
    df = frame(spark, values, True)
    want = None
    for data, options in [
        (df, {}),
        (df.repartition(7).orderBy(F.rand(3)), {}),
        (df, {"max_window_rows": 0, "rows_per_range": 50}),
        (df.repartition(13), {"max_window_rows": 0, "rows_per_range": 17}),
    ]:
        result = concentrate(data, "entity", "revenue", "period", [5, 50, 95, 100], **options)
        got = rows(result.metrics()), rows(result.head())
        want = want or got
        assert got == want


def test_metrics_against_plain_python(spark):
    rng = random.Random(11)
    values = [(f"e{i:04d}", round(rng.paretovariate(1.2) * 100, 2)) for i in range(3000)]
    found = figures(concentrate(frame(spark, values), "entity", "revenue", None, [10, 25, 50, 90]))
    cents = sorted(((round(v * 100), e) for e, v in values), key=lambda x: (-x[0], x[1]))
    total = sum(c for c, _ in cents)
    for x in (10, 25, 50, 90):
        running, kept = 0, []
        for c, e in cents:
            running += c
            if running * 100 <= x * total:
                kept.append((c, e))
        kept = kept or cents[:1]
        assert found[x][0] == len(kept)
        assert found[x][1] == pytest.approx(sum(c for c, _ in kept) / 100)
        assert found[x][3] == [e for _, e in kept[:10]]
    counts = [found[x][0] for x in (10, 25, 50, 90)]
    assert counts == sorted(counts) and all(found[x][2] <= 100 for x in found)


def test_step_log_and_warnings(spark):
    values = [("P1", "A", 10.0), ("P1", "B", 10.0), ("P2", "A", -1.0)]
    result = concentrate(frame(spark, values, True), "entity", "revenue", "period", [10, 50])
    log = {(r["step"], r["status"]) for r in result.step_log(limit=1).collect()}
    assert log == {
        ("period_identification", "completed"),
        ("aggregation_P1", "completed"),
        ("performance_warning_P1", "warning"),
        ("concentration_calculation_P1", "completed"),
        ("aggregation_P2", "completed"),
        ("error_P2", "failed"),
        ("aggregation_TOTAL", "completed"),
        ("performance_warning_TOTAL", "warning"),
        ("concentration_calculation_TOTAL", "completed"),
        ("summary_generation", "completed"),
    }
    assert result.size_warnings().count() == 0
    assert set(result.formulas()) == {"aggregation", "sorting", "cumulative_percentage", "top_10", "top_50"}
    assert [r["period"] for r in result.periods().collect()] == ["P1", "P2"]


def test_one_sort_and_one_shuffle_over_the_sums(spark):
    values = [("P1", "A", 10.0), ("P1", "B", 10.0)]
    plan = concentrate(frame(spark, values, True), "entity", "revenue", "period").metrics()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("Sort [") == 1


def test_ranges_never_collect_a_group_in_one_window(spark):
    values = [("P1", f"e{i}", float(i)) for i in range(100)]
    result = concentrate(frame(spark, values, True), "entity", "revenue", "period", max_window_rows=0, rows_per_range=20)
    largest = result.ranked.groupBy("slice").count().agg(F.max("count")).first()[0]
    assert largest < 100


def test_release(spark):
    result = concentrate(frame(spark, [("A", 1.0)]), "entity", "revenue")
    result.release()
    with pytest.raises(Exception):
        result.head().collect()


def test_head_is_a_top_k(spark):
    values = [("P1", f"e{i:03d}", float(i)) for i in range(100)]
    head = concentrate(frame(spark, values, True), "entity", "revenue", "period").head(3)
    assert "WindowGroupLimit" in head._jdf.queryExecution().executedPlan().toString()
    assert [r["entity"] for r in head.where("not is_total").orderBy("rnk").collect()] == ["e099", "e098", "e097"]


def brute_force(cents, thresholds):
    """Plain restatement for one group: {entity: cents} -> {threshold: (count, value, names)}."""
    total = sum(cents.values())
    if total <= 0:
        return {}
    ranked = sorted(cents.items(), key=lambda e: (-e[1], e[0]))
    found = {}
    for x in thresholds:
        running, kept = 0, []
        for name, value in ranked:
            running += value
            if running * 100 <= x * total:
                kept.append((name, value))
        kept = kept or ranked[:1]
        found[x] = (len(kept), sum(v for _, v in kept) / 100, [n for n, _ in kept[:10]])
    return found


def test_many_small_groups_against_brute_force(spark, limit):
    rng = random.Random(23)
    data, want = [], {}
    thresholds = [1, 10, 33, 50, 90, 100]
    for p in range(80):
        cents = {}
        for _ in range(rng.randrange(1, 60)):
            name = f"e{rng.randrange(30):02d}"
            # Few distinct values: ties, zeros and negatives are common.
            value = rng.choice([0, 100, 100, 250, 999, 5000, -100, -250, rng.randrange(-3000, 6000)])
            cents[name] = cents.get(name, 0) + value
            data.append((f"p{p:02d}", name, value / 100))
        want[f"p{p:02d}"] = brute_force(cents, thresholds)
    result = concentrate(
        frame(spark, data, True), "entity", "revenue", "period", thresholds, max_window_rows=limit, rows_per_range=40
    )
    got = {p: {} for p in want}
    for r in result.metrics().where("not is_total").collect():
        got[r["period"]][r["threshold"]] = (r["entity_count"], r["value"], list(r["entities"]))
    assert got == want


@pytest.mark.parametrize("max_window_rows", [500_000, 0])
def test_sixth_decimal_decides(spark, max_window_rows):
    rows = [("A", 10.000001), ("B", 10.000004)]
    result = concentrate(frame(spark, rows), "entity", "revenue", max_window_rows=max_window_rows)
    assert [(r["entity"], r["value"]) for r in result.head().orderBy("rnk").collect()] == [("B", 10.000004), ("A", 10.000001)]
    assert result.metrics().where("threshold = 50").first()["entities"] == ["B"]


@pytest.mark.parametrize("max_window_rows", [500_000, 0])
def test_values_out_of_range_give_their_group_a_status(spark, max_window_rows):
    rows = [("P", "A", float("inf")), ("P", "B", 1.0), ("Q", "A", 2.0), ("Q", None, float("-inf")), ("R", "C", 2e25)]
    result = concentrate(frame(spark, rows, True), "entity", "revenue", "period", max_window_rows=max_window_rows)
    found = {(r["is_total"], r["period"]): r["status"] for r in result.groups.collect()}
    assert found.pop((False, "Q")) == "ok"
    assert set(found.values()) == {"Total value is out of range; cannot compute concentration"}
    assert {r["period"] for r in result.metrics().collect()} == {r["period"] for r in result.head().collect()} == {"Q"}


def test_one_scan_of_the_input(spark, tmp_path):
    from topshare.operators.concentration import _overall, _summed

    frame(spark, [("P", "A", 1.0), (None, "B", 2.0)], True).write.parquet(str(tmp_path / "in"))
    summed = _summed(spark.read.parquet(str(tmp_path / "in")), "entity", "revenue", "period", None)
    assert summed._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    summed.write.parquet(str(tmp_path / "sums"))
    plan = _overall(spark.read.parquet(str(tmp_path / "sums")))._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "in") not in plan


def test_decimal_and_whole_number_measures(spark):
    frame_ = spark.sql("SELECT * FROM VALUES ('A', 1.00000000001BD, 9007199254740993L), ('B', 1.00000000002BD, 2L) t(entity, d, n)")
    result = concentrate(frame_, "entity", "d")
    assert [r["entity"] for r in result.head().orderBy("rnk").collect()] == ["B", "A"]
    result = concentrate(frame_, "entity", "n")
    assert result.totals.where("entity = 'A'").first()["amount"] == 9007199254740993


@pytest.mark.parametrize("max_window_rows", [500_000, 0])
def test_groups_of_very_different_size_keep_all_decimals(spark, max_window_rows):
    rows = [("p1", "A", 5e23), ("p2", "A", 3e-13), ("p2", "B", 1e-13), ("p3", "A", 5e23), ("p3", "B", 2e-13), ("p3", "C", 1e-13)]
    options = {"max_window_rows": max_window_rows, "rows_per_range": 2}
    result = concentrate(frame(spark, rows, True), "entity", "revenue", "period", [50, 80, 100], **options)
    assert {r["status"] for r in result.groups.collect()} == {"ok"}
    found = {(r["period"], r["threshold"]): (r["entity_count"], r["value"], r["entities"]) for r in result.metrics().collect()}
    assert len(found) == 12
    assert found["p2", 50] == (1, 3e-13, ["A"]) and found["p2", 80] == (1, 3e-13, ["A"]) and found["p2", 100][0] == 2
    # The last share is 100 percent only with the last of three, 36 digits below the first.
    assert found["p3", 100] == (3, 5e23, ["A", "B", "C"]) and found["p3", 80][0] == 1
    head = result.head().where("period = 'p3'").orderBy("rnk").collect()
    assert [(r["entity"], r["value"]) for r in head] == [("A", 5e23), ("B", 2e-13), ("C", 1e-13)]


@pytest.mark.parametrize("max_window_rows", [500_000, 0])
def test_the_fifteenth_decimal_beside_large_sums_decides(spark, max_window_rows):
    """Cuts at exactly the threshold, and one unit below it."""
    rows = [("A", 4e23), ("B", 3e23), ("C", 3e23), ("D", 1e-14), ("E", -1e-14), ("F", -1e-14)]
    texts = [(e, f"{v:.14f}" if abs(v) < 1 else f"{v:.0e}") for e, v in rows]
    exact = spark.createDataFrame(texts, "entity string, revenue string")
    exact = exact.withColumn("revenue", F.col("revenue").cast("decimal(38,14)"))
    result = concentrate(exact, "entity", "revenue", None, [40, 70, 100], max_window_rows=max_window_rows, rows_per_range=2)
    found = {r["threshold"]: (r["entity_count"], r["entities"]) for r in result.metrics().collect()}
    # The total is 1e24 - 1e-14: A has a little more than 40 percent and stands in, A and B a little more than 70;
    # A, B and C and, with D, more than all; with E just 1e24, with F the total itself.
    assert found == {40: (1, ["A"]), 70: (1, ["A"]), 100: (3, ["A", "B", "F"])}


def test_groups_beyond_the_types_get_a_status(spark):
    rows = [("P", f"e{i}", 9e23) for i in range(3)] + [("Q", "A", 1e-13), ("Q", "B", 3.0)]
    many = frame(spark, rows, True)
    from topshare.operators import concentration

    before = concentration._MOST
    concentration._MOST = 1e24
    try:
        result = concentrate(many, "entity", "revenue", "period")
        assert {(r["period"], r["status"] == "ok") for r in result.groups.collect()} == {("P", False), ("Q", True), ("TOTAL", False)}
        assert {r["period"] for r in result.metrics().collect()} == {"Q"} == {r["period"] for r in result.head().collect()}
    finally:
        concentration._MOST = before
