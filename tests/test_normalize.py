import pytest
from pyspark.sql import functions as F

from topshare.functions.naming import alias_for, standard_names
from topshare.functions.text_numbers import as_boolean, parse_numbers, percent_share
from topshare.operators.normalize import apply_plans, normalize, plan_normalization

NBSP, NARROW, MINUS = "\u00a0", "\u202f", "\u2212"


def numbers(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    return [r["v"] for r in parse_numbers(df, ["v"]).orderBy("i").collect()]


@pytest.mark.parametrize(
    "text, number, flags",
    [
        ("$1,234.56", 1234.56, {"currency": 1, "convention": "US"}),
        ("€ 1.234,56", 1234.56, {"currency": 1, "convention": "EU"}),
        ("(1,500.00)", -1500.0, {"parentheses": True}),
        ("¥1,000", 1000.0, {"currency": 1, "convention": "US"}),
        ("$2.5k", 2500.0, {"scaled": True}),
        (f"1{NBSP}234,50 €", 1234.5, {"convention": "EU"}),
        (f"CHF 1{NARROW}234.50", 1234.5, {"code": "CHF", "currency": 1}),
        (f"CHF 2{NARROW}500{NARROW}000.00", 2500000.0, {"code": "CHF"}),
        (f"{MINUS}1,234.50", -1234.5, {"minus": True}),
        (f"{MINUS}5", -5.0, {"minus": True, "coerced": True}),
        ("1,234.50-", -1234.5, {}),
        ("1.5k", 1500.0, {}),
        ("2.3K", 2300.0, {}),
        ("4.5m", 4500000.0, {}),
        ("6.7 M", 6700000.0, {}),
        ("8.9mm", 8900000.0, {}),
        ("1.2b", 1.2e9, {}),
        ("3.4B", 3.4e9, {}),
        ("5.6bn", 5.6e9, {"scaled": True}),
        ("1'234.50", 1234.5, {}),
        ("1'234'567.89", 1234567.89, {}),
        ("1,234.50$", 1234.5, {"currency": 1}),
        ("1,5", 1.5, {"convention": "EU"}),
        ("3,000", 3000.0, {"convention": "US"}),
        ("-2.5k", -2500.0, {}),
        ("1,234.5k", 1234500.0, {}),
        ("(€2.5k)", -2500.0, {}),
        ("Area 5 M", 5000000.0, {"scaled": True}),
        ("$ -5", -5.0, {"currency": 1}),
    ],
)
def test_cleaned_numbers(spark, text, number, flags):
    (value,) = numbers(spark, [text])
    assert value["number"] == pytest.approx(number)
    assert value["coerced"] and not value["plain"] and not value["failed"]
    for name, want in flags.items():
        assert value[name] == want


@pytest.mark.parametrize("text", ["12", " 12 ", "+1.5", ".5", "5.", "-3e2", f"{NBSP}7\t"])
def test_plain_numbers_are_no_coercion(spark, text):
    (value,) = numbers(spark, [text])
    assert value["plain"] and not value["coerced"] and value["number"] == float(text)


@pytest.mark.parametrize("text", ["abc", "123xyz", "!@#$", "85%", "1.2.3", "1d", "2.5F", "inf", "1,234,56", "--", "()", "-", "5--"])
def test_failed_numbers(spark, text):
    (value,) = numbers(spark, [text])
    assert value["failed"] and value["number"] is None


@pytest.mark.parametrize("text", ["", "  ", None, "NaN", "nan"])
def test_no_numbers(spark, text):
    (value,) = numbers(spark, [text])
    assert value["number"] is None and not (value["failed"] or value["coerced"] or value["plain"])


def test_percents(spark):
    df = spark.createDataFrame([(x,) for x in ["85%", "12.5%", "0.5 %", "100%", "85", "1", "0.5", "101", "x%", None]], "v string")
    marked = [r[0] for r in df.select(percent_share(F.col("v"), False)["number"]).collect()]
    assert marked == [0.85, 0.125, 0.005, 1.0, 85.0, 1.0, 0.5, 101.0, None, None]
    header = df.select(percent_share(F.col("v"), True).alias("p")).select("p.*").collect()
    assert [r["number"] for r in header] == [0.85, 0.125, 0.005, 1.0, 0.85, 1.0, 0.5, 101.0, None, None]
    assert [r["changed"] for r in header] == [True] * 5 + [False] * 5


def test_booleans(spark):
    words = ["yes", "No", " Y ", "n", "TRUE", "false", "t", "F", "1", "0", "maybe", "", None]
    df = spark.createDataFrame([(w,) for w in words], "v string")
    got = [r[0] for r in df.select(as_boolean(F.col("v"))).collect()]
    assert got == [True, False] * 5 + [None] * 3


def test_header_names():
    assert standard_names(["  Revenue (USD)  ", "Gross Profit", "Product Mix", "Product Mix", "product-mix", "__x__", "Année"]) == {
        "revenue_usd": "  Revenue (USD)  ",
        "gross_profit": "Gross Profit",
        "product_mix": "Product Mix",
        "product_mix_2": "Product Mix",
        "product_mix_3": "product-mix",
        "x": "__x__",
        "année": "Année",
    }
    assert list(standard_names(["%", "#"])) == ["column", "column_2"]
    assert standard_names(["a", "a_2", "a"]) == {"a": "a", "a_2": "a_2", "a_3": "a"}


def test_alias_is_stable():
    assert alias_for("customer_id") == alias_for("customer_id") != alias_for("account_no")
    assert alias_for("customer_id").startswith("[ANONYMIZED_COLUMN_")
    assert alias_for("region") == "region"


def plans(spark, **columns):
    names = list(columns)
    data = list(zip(*columns.values()))
    schema = ", ".join(f"`{n}` string" for n in names)
    return {p.name: p for p in plan_normalization(spark.createDataFrame(data, schema))}


def test_branches(spark):
    found = plans(
        spark,
        money=["$1", "2", None, "x"],
        share=["15%", "n/a", "8%", None],
        margin=["0.5", "0.7", "1", None],
        ratio=["85", "0.5", "100", None],
        created=["2024-01-15", "soon", None, "01/20/2024"],
        active=["Yes", "no", "t", None],
        mostly=["yes", "no", "maybe", "idk"],
        whole=["1", "2", "NA", "3"],
        broken=["1.5", "2", "3", None],
        words=["a", "b", None, "c"],
        logical=["True", "False", "True", None],
        nothing=[None, "", "NA", None],
    )
    assert {n: p.branch for n, p in found.items()} == {
        "money": "numeric_coercion",
        "share": "percent_normalization",
        "margin": "percent_representation",
        "ratio": "percent_normalization",
        "created": "datetime_coercion",
        "active": "boolean_coercion",
        "mostly": "unchanged",
        "whole": "plain_integer",
        "broken": "plain_number",
        "words": "unchanged",
        "logical": "boolean_coercion",
        "nothing": "unchanged",
    }
    assert found["money"].counters["failed_numeric_coercions"] == 1
    assert found["money"].failed_ratio == pytest.approx(1 / 3)
    assert found["created"].counters == {"datetime_parsed": 2, "parsing_errors": 1}
    assert found["margin"].representation == found["share"].representation == "percent"


def test_percent_header_stops_the_cascade(spark):
    # Dates under a name that also says rate: neither dates nor booleans are tried.
    found = plans(spark, rate_date=["2024-01-15", "2024-01-16"], margin_flag=["yes", "no"])
    assert {p.branch for p in found.values()} == {"percent_representation"}


def test_unanchored_header_patterns(spark):
    found = plans(spark, corporate=["x", "y"], lifetime=["2024-01-15", "z"])
    assert found["corporate"].branch == "percent_representation"
    assert found["lifetime"].branch == "datetime_coercion"


def test_percent_name_on_numeric_branch_keeps_values(spark):
    df = spark.createDataFrame([("$85",), ("0.5",)], "`Margin %` string")
    result = normalize(df)
    assert result.plans[0].branch == "numeric_coercion" and result.plans[0].representation == "percent"
    assert sorted(r[0] for r in result.data.select("margin").collect()) == [0.5, 85.0]


def test_typed_columns(spark):
    df = spark.createDataFrame([(85.0, 1, True), (0.5, 0, False), (None, 1, None)], "profit_pct double, qty int, ok boolean")
    result = normalize(df)
    assert [p.branch for p in result.plans] == ["percent_normalization", "unchanged", "boolean_coercion"]
    assert [r[0] for r in result.data.select("profit_pct").collect()] == [0.85, 0.5, None]
    assert dict(result.data.dtypes)["qty"] == "int"


def test_conventions_and_currencies(spark):
    found = plans(
        spark,
        us=["1,234.56", "2,345.67", "3,456.78", None],
        eu=["1.234,56", "2.345,67", "3.456,78", None],
        mixed=["1,234.56", "2.345,67", "3,000", "4.500,00"],
        money=["$100", "€50", "1,234.50$", "CHF 1,234.50"],
    )
    assert [found[n].decimal_convention for n in ("us", "eu", "mixed")] == ["US", "EU", "mixed"]
    assert found["money"].currencies == ["$", "CHF", "€"]


def test_whole_table(spark):
    df = spark.createDataFrame(
        [
            ("$1,000", "15%", "2024-01-15", "Yes", "first"),
            ("(500)", "20%", "2024-02-20", "No", None),
            ("€2.5k", "8%", "2024-03-01", "Y", "N/A"),
            ("bad", "3%", "later", "N", "last"),
        ],
        "`  Revenue (USD)  ` string, `Margin %` string, `Transaction Date` string, Active string, Notes string",
    )
    result = normalize(df)
    assert dict(result.data.dtypes) == {
        "revenue_usd": "double",
        "margin": "double",
        "transaction_date": "timestamp",
        "active": "boolean",
        "notes": "string",
        "period_key": "string",
    }
    got = result.data.select("revenue_usd", "margin", "active", "notes", "period_key").collect()
    assert [tuple(r) for r in got] == [
        (1000.0, 0.15, True, "first", "ALL"),
        (-500.0, 0.2, False, None, "ALL"),
        (2500.0, 0.08, True, None, "ALL"),
        (None, 0.03, False, "last", "ALL"),
    ]
    assert [s["step"] for s in result.transformations()] == [
        "header_standardization", "numeric_coercion", "percent_normalization", "datetime_coercion", "boolean_coercion",
    ]
    assert result.names["revenue_usd"] == "  Revenue (USD)  "


def test_mixed_conventions_warn(spark):
    result = normalize(spark.createDataFrame([("1,234.56",), ("2.345,67",)], "amount string"))
    assert any("mixed decimal conventions" in w and "amount" in w for w in result.warnings)


def test_empty_input(spark):
    with pytest.raises(ValueError):
        normalize(spark.createDataFrame([], "a string"))


def test_plan_size_does_not_grow_with_columns(spark):
    from topshare.operators.normalize import column_counters

    def size(n):
        df = spark.createDataFrame([tuple("x" for _ in range(n))], ", ".join(f"c{i} string" for i in range(n)))
        return len(column_counters(df)._jdf.queryExecution().optimizedPlan().toString())

    assert size(40) < 2 * size(10)


def test_long_ids_stay_apart(spark):
    ids = ["1234567890123456781", "1234567890123456782"]
    wider = ["92233720368547758080", "92233720368547758081"]
    digits = ["1" * 39 + "1", "1" * 39 + "2"]
    df = spark.createDataFrame(list(zip(ids, wider, digits)), "a string, b string, c string")
    data = apply_plans(df, plan_normalization(df))
    assert dict(data.dtypes) == {"a": "bigint", "b": "decimal(38,0)", "c": "string"}
    assert {str(r["a"]) for r in data.collect()} == set(ids)
    assert {str(r["b"]) for r in data.collect()} == set(wider) and {r["c"] for r in data.collect()} == set(digits)
