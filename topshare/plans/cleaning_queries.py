"""Text made messy from the tables, cleaned again; time keys; profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from topshare.functions import dates
from topshare.functions.text_numbers import as_boolean, parse_numbers, percent_share, rescaled
from topshare.operators.dataset import column_schema
from topshare.operators.normalize import apply_plans, cascade, normalize, plans_from
from topshare.operators.profile import (
    column_kinds,
    dataset_metadata,
    negative_policy,
    null_and_distinct,
    one_row,
    outliers,
    profile,
    transformation_summary,
)
from topshare.operators.timekey import TimeSpec, detect_time, time_checks, unknown_share, with_period_key
from topshare.plans.common import table
from topshare.session import materialize

QUERIES, ORACLES = {}, {}

# -- rendering: the same numbers, written in many ways ---------------------------

def _cents():
    return F.round(F.col("o_totalprice") * 100).cast("bigint")


def _grouped(mark: str):
    """Whole part with a thousands mark; order totals stay under a million."""
    whole = F.floor(_cents() / 100)
    rest = F.lpad((whole % 1000).cast("string"), 3, "0")
    return F.when(whole >= 1000, F.concat(F.floor(whole / 1000).cast("string"), F.lit(mark), rest)).otherwise(
        whole.cast("string")
    )


def _money(form):
    cents = F.lpad((_cents() % 100).cast("string"), 2, "0")
    us = F.concat(_grouped(","), F.lit("."), cents)
    whole = F.floor(_cents() / 100)
    return (
        F.when(form == 0, F.concat(F.lit("$"), us))
        .when(form == 1, F.concat(F.lit("€ "), _grouped("."), F.lit(","), cents))
        .when(form == 2, F.concat(F.lit("("), us, F.lit(")")))
        .when(form == 3, F.concat(us, F.lit("-")))
        .when(form == 4, F.concat(F.lit("\u2212"), us))
        .when(form == 5, F.concat(F.lit("CHF "), _grouped("\u202f"), F.lit("."), cents))
        .when(
            form == 6,
            F.concat(
                F.floor(whole / 1000).cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit("k")
            ),
        )
        .when(form == 7, F.lit("unknown"))
        .otherwise(F.concat(whole.cast("string"), F.lit("."), cents))
    )


#: More ways: the other symbols and codes, scale suffixes, and an apostrophe between thousands.
_MORE_MARKS = [("£", 0), ("¥", 0), ("USD ", 1), ("EUR ", 1), ("GBP ", 1), ("JPY ", 1)]
_MORE_SCALES = [("m", 6), ("mm", 6), ("b", 9), ("bn", 9), ("K", 3)]


def _more_money(form):
    cents = F.lpad((_cents() % 100).cast("string"), 2, "0")
    whole = F.floor(_cents() / 100).cast("string")
    text = F.when(form == 0, F.concat(_grouped("'"), F.lit("."), cents))
    for i, (mark, _) in enumerate(_MORE_MARKS, 1):
        text = text.when(form == i, F.concat(F.lit(mark), whole, F.lit("."), cents))
    for i, (suffix, _) in enumerate(_MORE_SCALES, 1 + len(_MORE_MARKS)):
        text = text.when(form == i, F.concat(whole, F.lit(suffix)))
    return text


def coerce_currency_more(spark, d):
    forms = 1 + len(_MORE_MARKS) + len(_MORE_SCALES)
    orders = table(spark, d, "orders", spread=True).select("o_orderkey", _more_money(F.col("o_orderkey") % forms).alias("amount"))
    return parse_numbers(orders, ["amount"]).select(
        "o_orderkey",
        F.round("amount.number", 2).alias("number"),
        "amount.currency",
        "amount.scaled",
        F.array_join("amount.symbols", "|").alias("symbols"),
        "amount.code",
    )


def _more_sql():
    form = f"o_orderkey % {1 + len(_MORE_MARKS) + len(_MORE_SCALES)}"
    cents = "CAST(round(o_totalprice * 100) AS BIGINT)"
    first = 1 + len(_MORE_MARKS)
    scales = " ".join(f"WHEN {i} THEN ({cents} // 100) * 1e{power}" for i, (_, power) in enumerate(_MORE_SCALES, first))
    symbols = " ".join(f"WHEN {i} THEN '{m}'" for i, (m, code) in enumerate(_MORE_MARKS, 1) if not code)
    codes = " ".join(f"WHEN {i} THEN '{m.strip()}'" for i, (m, code) in enumerate(_MORE_MARKS, 1) if code)
    return (
        f"SELECT o_orderkey, CAST(round(CASE {form} {scales} ELSE {cents} / 100.0 END, 2) AS DOUBLE) AS number, "
        f"CAST({form} BETWEEN 1 AND {len(_MORE_MARKS)} AS INTEGER) AS currency, {form} >= {first} AS scaled, "
        f"CASE {form} {symbols} END AS symbols, CASE {form} {codes} END AS code FROM orders"
    )


ORACLES["coerce_currency_more"] = _more_sql()


_SQL_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_SQL_FORM = "o_orderkey % 9"
_SQL_NUMBER = f"""CASE {_SQL_FORM} WHEN 7 THEN NULL WHEN 6 THEN CAST({_SQL_CENTS} // 100 AS DOUBLE)
 WHEN 2 THEN -{_SQL_CENTS} / 100.0 WHEN 3 THEN -{_SQL_CENTS} / 100.0 WHEN 4 THEN -{_SQL_CENTS} / 100.0 ELSE {_SQL_CENTS} / 100.0 END"""


def coerce_currency(spark, d):
    orders = table(spark, d, "orders", spread=True).select("o_orderkey", _money(F.col("o_orderkey") % 9).alias("amount"))
    return parse_numbers(orders, ["amount"]).select(
        "o_orderkey",
        F.round("amount.number", 2).alias("number"),
        "amount.plain",
        "amount.coerced",
        "amount.failed",
        "amount.currency",
        "amount.parentheses",
        "amount.scaled",
        "amount.minus",
        "amount.convention",
        F.array_join("amount.symbols", "|").alias("symbols"),
        "amount.code",
    )


ORACLES["coerce_currency"] = f"""SELECT o_orderkey, CAST(round({_SQL_NUMBER}, 2) AS DOUBLE) AS number, {_SQL_FORM} = 8 AS plain,
{_SQL_FORM} NOT IN (7, 8) AS coerced, {_SQL_FORM} = 7 AS failed, CAST({_SQL_FORM} IN (0, 1, 5) AS INTEGER) AS currency,
{_SQL_FORM} = 2 AS parentheses, {_SQL_FORM} = 6 AS scaled, {_SQL_FORM} = 4 AS minus,
CASE WHEN {_SQL_FORM} = 1 THEN 'EU' WHEN {_SQL_FORM} IN (0, 2, 3, 4) AND {_SQL_CENTS} >= 100000 THEN 'US' END AS convention,
CASE {_SQL_FORM} WHEN 0 THEN '$' WHEN 1 THEN '€' END AS symbols, CASE {_SQL_FORM} WHEN 5 THEN 'CHF' END AS code FROM orders"""


def coerce_percent(spark, d):
    """Discounts as "5%", as whole percents under a percent header, and as they are."""
    lines = table(spark, d, "lineitem", spread=True).select(
        "l_returnflag",
        F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")).alias("marked"),
        F.round(F.col("l_discount") * 100).cast("int").cast("string").alias("discount_pct"),
        F.round(F.col("l_discount") * 100, 0).alias("margin"),
    )
    marked, header = percent_share(F.col("marked"), False), percent_share(F.col("discount_pct"), True)
    return (
        lines.select("l_returnflag", marked.alias("a"), header.alias("b"), rescaled(F.col("margin")).alias("c"))
        .groupBy("l_returnflag")
        .agg(
            F.count(F.when(F.col("a.changed"), 1)).alias("n_marked"),
            F.count(F.when(F.col("b.changed"), 1)).alias("n_rescaled"),
            F.round(F.sum(F.col("a.number").cast("decimal(10,4)")).cast("double"), 4).alias("sum_marked"),
            F.round(F.sum(F.col("b.number").cast("decimal(10,4)")).cast("double"), 4).alias("sum_header"),
            F.round(F.sum(F.col("c").cast("decimal(10,4)")).cast("double"), 4).alias("sum_numeric"),
        )
    )


ORACLES["coerce_percent"] = """WITH p AS (SELECT l_returnflag, CAST(round(l_discount * 100) AS INTEGER) AS pct FROM lineitem)
SELECT l_returnflag, count(*) AS n_marked, count(*) FILTER (WHERE pct > 1) AS n_rescaled,
round(CAST(sum(pct) AS DOUBLE) / 100, 4) AS sum_marked,
round(CAST(sum(CASE WHEN pct > 1 THEN pct ELSE pct * 100 END) AS DOUBLE) / 100, 4) AS sum_header,
round(CAST(sum(CASE WHEN pct > 1 THEN pct ELSE pct * 100 END) AS DOUBLE) / 100, 4) AS sum_numeric
FROM p GROUP BY l_returnflag"""


def coerce_boolean(spark, d):
    word = (
        F.when(F.col("o_orderkey") % 8 == 0, "Yes")
        .when(F.col("o_orderkey") % 8 == 1, " no ")
        .when(F.col("o_orderkey") % 8 == 2, "T")
        .when(F.col("o_orderkey") % 8 == 3, "FALSE")
        .when(F.col("o_orderkey") % 8 == 4, "1")
        .when(F.col("o_orderkey") % 8 == 5, "0")
        .when(F.col("o_orderkey") % 8 == 6, "maybe")
    )
    return (
        table(spark, d, "orders")
        .select("o_orderstatus", word.alias("word"), as_boolean(word).alias("flag"))
        .groupBy("o_orderstatus")
        .agg(
            F.count(F.when(F.col("flag"), 1)).alias("n_true"),
            F.count(F.when(~F.col("flag"), 1)).alias("n_false"),
            F.count(F.when(F.col("word").isNotNull() & F.col("flag").isNull(), 1)).alias("n_left_over"),
        )
    )


ORACLES["coerce_boolean"] = """SELECT o_orderstatus, count(*) FILTER (WHERE o_orderkey % 8 IN (0, 2, 4)) AS n_true,
count(*) FILTER (WHERE o_orderkey % 8 IN (1, 3, 5)) AS n_false, count(*) FILTER (WHERE o_orderkey % 8 = 6) AS n_left_over
FROM orders GROUP BY o_orderstatus"""

_DATE_FORMS = [
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "M/d/yy", "dd MMM yyyy", "d MMMM yyyy", "MMM d, yyyy",
    "MMMM d, yyyy", "yyyyMMdd", "yyyy/MM/dd",
]


def _date_text(form):
    text = F.when(form == len(_DATE_FORMS), F.lit("not a date"))
    for i, layout in enumerate(_DATE_FORMS):
        text = text.when(form == i, F.date_format("o_orderdate", layout))
    # Days above 12 written day first are read as such.
    return text.when((form == 11) & (F.dayofmonth("o_orderdate") > 12), F.date_format("o_orderdate", "dd/MM/yyyy"))


def coerce_datetime(spark, d):
    text = _date_text(F.col("o_orderkey") % 12)
    parsed = dates.parse_timestamp(F.col("text"))
    return (
        table(spark, d, "orders", spread=True)
        .select("o_orderkey", text.alias("text"))
        .select("o_orderkey", F.col("text").isNotNull().alias("present"), parsed.cast("date").cast("string").alias("day"))
    )


ORACLES["coerce_datetime"] = """SELECT o_orderkey, NOT (o_orderkey % 12 = 11 AND day(o_orderdate) <= 12) AS present,
CASE WHEN o_orderkey % 12 = 10 OR (o_orderkey % 12 = 11 AND day(o_orderdate) <= 12) THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day
FROM orders"""

# -- whole tables ------------------------------------------------------------


def _messy_orders(spark, d):
    """Orders as a raw text table under raw headers."""
    key = F.col("o_orderkey")
    return table(spark, d, "orders", spread=True).select(
        key.cast("string").alias("Order Key"),
        _money(key % 9).alias("  Amount (USD) "),
        F.when(key % 4 == 3, "N/A").otherwise(F.concat((key % 90).cast("string"), F.lit("%"))).alias("Discount %"),
        (key % 90 / 100).cast("string").alias("Tax Rate"),
        _date_text(key % 11).alias("Order Date"),
        F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "No").otherwise("").alias("Closed"),
        F.when(key % 2 == 0, "True").otherwise("False").alias("Even"),
        F.col("o_orderpriority").alias("Priority"),
        F.col("o_orderpriority").alias("priority"),
        F.year("o_orderdate").cast("string").alias("Year"),
        F.when(key % 5 == 0, F.date_format("o_orderdate", "MMMM"))
        .when(key % 5 == 1, F.date_format("o_orderdate", "MMM"))
        .otherwise(F.month("o_orderdate").cast("string"))
        .alias("Month"),
    )


def normalize_cascade(spark, d):
    from topshare.functions.naming import standard_names

    raw = _messy_orders(spark, d)
    names = standard_names(raw.columns)
    rows = cascade(raw.toDF(*names), names)
    return rows.select(
        "column_name",
        "original_name",
        "branch",
        "typed",
        "representation",
        "decimal_convention",
        F.array_join("currencies", "|").alias("currencies"),
        *[
            F.when(F.col("branch") == branch, F.col(counter)).otherwise(0).alias(counter)
            for counter, branch in {
                "successful_coercions": "numeric_coercion",
                "failed_numeric_coercions": "numeric_coercion",
                "currency_removed": "numeric_coercion",
                "parentheses_to_negative": "numeric_coercion",
                "scaling_applied": "numeric_coercion",
                "unicode_minus_normalized": "numeric_coercion",
                "percent_normalized": "percent_normalization",
                "datetime_parsed": "datetime_coercion",
                "parsing_errors": "datetime_coercion",
                "boolean_coerced": "boolean_coercion",
            }.items()
        ],
    )


def _cascade_row(name, original, branch, typed="NULL", representation="NULL", convention="NULL", currencies="''", **counts):
    counters = [
        "successful_coercions", "failed_numeric_coercions", "currency_removed", "parentheses_to_negative", "scaling_applied",
        "unicode_minus_normalized", "percent_normalized", "datetime_parsed", "parsing_errors", "boolean_coerced",
    ]
    figures = ", ".join(
        f"count(*) FILTER (WHERE {counts[c]}) AS {c}" if c in counts else f"count(*) * 0 AS {c}" for c in counters
    )
    return (
        f"SELECT '{name}' AS column_name, '{original}' AS original_name, '{branch}' AS branch, {typed} AS typed, "
        f"{representation} AS representation, {convention} AS decimal_convention, {currencies} AS currencies, {figures} FROM orders"
    )


_F = _SQL_FORM
ORACLES["normalize_cascade"] = " UNION ALL ".join(
    [
        _cascade_row("order_key", "Order Key", "plain_integer", "'plain_integer'"),
        _cascade_row(
            "amount_usd", "  Amount (USD) ", "numeric_coercion", convention="'mixed'", currencies="'$|CHF|€'",
            successful_coercions=f"{_F} NOT IN (7, 8)", failed_numeric_coercions=f"{_F} = 7",
            currency_removed=f"{_F} IN (0, 1, 5)", parentheses_to_negative=f"{_F} = 2", scaling_applied=f"{_F} = 6",
            unicode_minus_normalized=f"{_F} = 4",
        ),
        _cascade_row("discount", "Discount %", "percent_normalization", representation="'percent'", percent_normalized="o_orderkey % 4 <> 3"),
        _cascade_row("tax_rate", "Tax Rate", "percent_representation", "'plain_number'", "'percent'"),
        _cascade_row("order_date", "Order Date", "datetime_coercion", datetime_parsed="o_orderkey % 11 <> 10", parsing_errors="o_orderkey % 11 = 10"),
        _cascade_row("closed", "Closed", "boolean_coercion", boolean_coerced="o_orderstatus IN (''F'', ''O'')".replace("''", "'")),
        _cascade_row("even", "Even", "boolean_coercion", boolean_coerced="true"),
        _cascade_row("priority", "Priority", "unchanged"),
        _cascade_row("priority_2", "priority", "unchanged"),
        _cascade_row("year", "Year", "plain_integer", "'plain_integer'"),
        _cascade_row("month", "Month", "unchanged"),
    ]
)


def normalize_table(spark, d):
    """The cleaned table, summed per period key of its own time columns."""
    result = normalize(_messy_orders(spark, d))
    return (
        result.data.groupBy("period_key")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count("order_date").alias("n_dates"),
            F.count("amount_usd").alias("n_amounts"),
            F.round(F.sum(F.round(F.col("amount_usd") * 100).cast("bigint")) / 100, 2).alias("sum_amount"),
            F.sum(F.round(F.col("discount") * 100).cast("bigint")).alias("sum_discount"),
            F.count(F.when(F.col("closed"), 1)).alias("n_closed"),
            F.count(F.when(F.col("even"), 1)).alias("n_even"),
            F.max("order_key").alias("max_key"),
        )
    )


ORACLES["normalize_table"] = f"""SELECT {{key}} AS period_key, count(*) AS n_rows, count(*) AS n_dates,
count(*) FILTER (WHERE {_F} <> 7) AS n_amounts,
round(coalesce(sum(CAST(round(({_SQL_NUMBER}) * 100) AS BIGINT)), 0) / 100, 2) AS sum_amount,
CAST(sum(CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 90 END) AS BIGINT) AS sum_discount,
count(*) FILTER (WHERE o_orderstatus = 'F') AS n_closed, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS n_even,
max(o_orderkey) AS max_key FROM orders GROUP BY 1""".replace(
    "{key}", "year(o_orderdate) || '-M' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0')"
).replace("count(*) AS n_dates", "count(*) FILTER (WHERE o_orderkey % 11 <> 10) AS n_dates")


def normalize_unknown_share(spark, d):
    """How many keys of a table with broken year and month texts are UNKNOWN."""
    return unknown_share(with_period_key(_broken_times(spark, d), TimeSpec("year_month", {"year": "y", "month": "m"})))


# -- time -----------------------------------------------------------------------


def _broken_times(spark, d):
    key, when = F.col("o_orderkey"), F.col("o_orderdate")
    return table(spark, d, "orders", spread=True).select(
        F.when(key % 7 == 0, "n/a")
        .when(key % 7 == 1, F.concat(F.year(when).cast("string"), F.lit(".0")))
        .when(key % 7 == 2, F.concat(F.lit(" "), F.year(when).cast("string"), F.lit(" ")))
        .otherwise(F.year(when).cast("string"))
        .alias("y"),
        F.when(key % 5 == 0, F.date_format(when, "MMMM"))
        .when(key % 5 == 1, F.upper(F.date_format(when, "MMM")))
        .when(key % 5 == 2, F.lit("sept"))
        .when(key % 5 == 3, F.lit("13"))
        .otherwise(F.month(when).cast("string"))
        .alias("m"),
        F.when(key % 3 == 0, F.concat(F.lit("q"), F.quarter(when).cast("string")))
        .when(key % 3 == 1, F.quarter(when).cast("string"))
        .otherwise(F.lit("Q5"))
        .alias("q"),
        F.when(key % 4 == 0, F.lit("someday")).otherwise(F.date_format(when, "MM/dd/yyyy")).alias("day"),
    )


def period_key_bad_values(spark, d):
    """Rows per key of every grain, from texts that are partly broken."""
    broken = _broken_times(spark, d)
    keys = {
        "date": dates.date_key(dates.parse_timestamp(F.col("day"))),
        "year_month": dates.year_month_key(F.col("y"), F.col("m")),
        "year_quarter": dates.year_quarter_key(F.col("y"), F.col("q")),
        "year": dates.year_key(F.col("y")),
        "none": F.lit(dates.ALL),
    }
    long = broken.select(*[k.alias(g) for g, k in keys.items()]).unpivot([], list(keys), "grain", "period_key")
    return long.groupBy("grain", "period_key").agg(F.count(F.lit(1)).alias("n"))


_Y = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS VARCHAR) END"
_M = "CASE WHEN o_orderkey % 5 IN (2, 3) THEN NULL ELSE lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') END"
_Q = "CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(quarter(o_orderdate) AS VARCHAR) END"
ORACLES["period_key_bad_values"] = " UNION ALL ".join(
    f"SELECT '{grain}' AS grain, coalesce({key}, 'UNKNOWN') AS period_key, count(*) AS n FROM orders GROUP BY 2"
    for grain, key in {
        "date": "CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END",
        "year_month": f"({_Y}) || '-M' || ({_M})",
        "year_quarter": f"({_Y}) || '-Q' || ({_Q})",
        "year": _Y,
        "none": "'ALL'",
    }.items()
)
ORACLES["normalize_unknown_share"] = """WITH k AS (SELECT count(*) AS n_rows,
count(*) FILTER (WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 IN (2, 3)) AS n_unknown FROM orders)
SELECT n_rows, n_unknown, CAST(n_unknown AS DOUBLE) / n_rows AS unknown_share FROM k"""


def _timed_lines(spark, d):
    when, key = F.col("l_shipdate"), F.col("l_orderkey")
    return table(spark, d, "lineitem", spread=True).select(
        when.alias("date"),
        F.date_format(when, "MM/dd/yyyy").alias("dt_text"),
        F.year(when).alias("year"),
        F.when(key % 2 == 0, F.year(when)).otherwise(0).alias("yr"),
        F.date_format(when, "MMMM").alias("month_name"),
        F.when(key % 10 < 8, F.date_format(when, "MMM")).otherwise("?").alias("label"),
        F.concat(F.lit("Q"), F.quarter(when).cast("string")).alias("quarter"),
        F.col("l_linenumber").alias("qtr"),
        F.col("l_returnflag").alias("flag"),
    )


def time_candidates(spark, d):
    return time_checks(_timed_lines(spark, d)).select("column_name", "kind", "n", "n_valid", "is_candidate")


ORACLES["time_candidates"] = """WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_orderkey % 2 = 0) AS even,
count(*) FILTER (WHERE l_orderkey % 10 < 8) AS most, count(*) FILTER (WHERE l_linenumber BETWEEN 1 AND 4) AS low FROM lineitem)
SELECT 'date' AS column_name, 'date' AS kind, n, n AS n_valid, true AS is_candidate FROM t
UNION ALL SELECT 'dt_text', 'date', n, n, true FROM t
UNION ALL SELECT 'year', 'year', n, n, true FROM t
UNION ALL SELECT 'yr', 'year', n, even, even >= n * 0.7 FROM t
UNION ALL SELECT 'month_name', 'month', n, n, true FROM t
UNION ALL SELECT 'label', 'month', n, most, most >= n * 0.7 FROM t
UNION ALL SELECT 'quarter', 'month', n, 0, false FROM t
UNION ALL SELECT 'quarter', 'quarter', n, n, true FROM t
UNION ALL SELECT 'qtr', 'quarter', n, low, low >= n * 0.7 FROM t
UNION ALL SELECT 'flag', 'month', n, 0, false FROM t"""


def time_detection(spark, d):
    """Detect the grain of the lines without their dates and count rows per key."""
    lines = _timed_lines(spark, d).drop("date", "dt_text", "month_name", "label")
    spec = detect_time(lines)
    keyed = with_period_key(lines, spec)
    return keyed.groupBy("period_key").agg(F.count(F.lit(1)).alias("n"), F.lit(spec.grain).alias("grain"))


ORACLES["time_detection"] = """SELECT year(l_shipdate) || '-Q' || quarter(l_shipdate) AS period_key, count(*) AS n, 'year_quarter' AS grain
FROM lineitem GROUP BY 1"""

# -- profile ------------------------------------------------------------------------


def _gappy_lines(spark, d):
    """Line items with a null discount in every seventh order and mostly null taxes."""
    return table(spark, d, "lineitem", spread=True).select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_orderkey") % 7 == 0, F.col("l_tax")).otherwise(F.lit(float("nan"))).alias("l_tax"),
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
    )


_GAPPY = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
CASE WHEN l_orderkey % 7 <> 0 THEN l_discount END AS l_discount, CASE WHEN l_orderkey % 7 = 0 THEN l_tax END AS l_tax,
l_returnflag, l_linestatus, l_shipdate FROM lineitem)"""
_CUSTOMER_COLUMNS = {
    "c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text",
}
_LINE_COLUMNS = {
    "l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number", "l_quantity": "number",
    "l_extendedprice": "number", "l_discount": "number", "l_tax": "number", "l_returnflag": "text", "l_linestatus": "text",
    "l_shipdate": "time",
}


def _profile_view(frame):
    return frame.select(
        "column_name",
        "role",
        "n_rows",
        "null_count",
        F.round("null_rate", 9).alias("null_rate"),
        "high_null_rate",
        "cardinality",
        "low_cardinality",
        "negative_count",
        "outlier_count",
    )


def profile_columns(spark, d):
    lines = _profile_view(profile(_gappy_lines(spark, d)))
    return lines.unionByName(_profile_view(profile(table(spark, d, "customer"))))


def _profile_sql(source: str, column: str, kind: str) -> str:
    numeric = kind == "number"
    x = f"CAST({column} AS DOUBLE)"
    outlier = (
        f"(SELECT count(*) FILTER (WHERE abs({x} - f.mean) > 3 * f.std) FROM {source} r, "
        f"(SELECT avg({x}) AS mean, stddev_samp({x}) AS std FROM {source} q) f)"
        if numeric
        else "NULL"
    )
    negative = f"count(*) FILTER (WHERE {column} < 0)" if numeric else "NULL"
    role = (
        f"CASE WHEN count(DISTINCT {column}) > least(50, greatest(5, count(*) // 10)) OR count(DISTINCT {column}) > count(*) * 0.5 "
        "THEN 'numeric' ELSE 'categorical' END"
        if numeric
        else "'datetime'" if kind == "time" else "'categorical'"
    )
    return f"""SELECT '{column}' AS column_name, {role} AS role, count(*) AS n_rows, count(*) - count({column}) AS null_count,
round(CAST(count(*) - count({column}) AS DOUBLE) / count(*), 9) AS null_rate, count({column}) < count(*) * 0.5 AS high_null_rate,
count(DISTINCT {column}) AS cardinality, count(*) > 100 AND count(DISTINCT {column}) < 5 AS low_cardinality,
CAST({negative} AS BIGINT) AS negative_count, CAST({outlier} AS BIGINT) AS outlier_count FROM {source} t"""


ORACLES["profile_columns"] = " UNION ALL ".join(
    [_profile_sql(_GAPPY, c, k) for c, k in _LINE_COLUMNS.items()]
    + [_profile_sql("customer", c, k) for c, k in _CUSTOMER_COLUMNS.items()]
)


def profile_text_columns(spark, d):
    """Distinct counts of whole documents: long texts count by digest."""
    return null_and_distinct(table(spark, d, "documents"))


ORACLES["profile_text_columns"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS cardinality FROM documents"
    for c in ("doc_id", "text", "lang", "source", "n_chars")
)


def outlier_counts(spark, d):
    found = outliers(table(spark, d, "lineitem")).unionByName(outliers(table(spark, d, "events")))
    return found.select("column_name", "n_values", "outlier_count", F.round("outlier_rate", 9).alias("outlier_rate"))


ORACLES["outlier_counts"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS n_values, count(*) FILTER (WHERE abs({c} - mean) > 3 * std) AS outlier_count,
round(CAST(count(*) FILTER (WHERE abs({c} - mean) > 3 * std) AS DOUBLE) / count({c}), 9) AS outlier_rate
FROM {t}, (SELECT avg({c}) AS mean, stddev_samp({c}) AS std FROM {t}) f"""
    for t, c in [
        *[("lineitem", c) for c, kind in _LINE_COLUMNS.items() if kind == "number"],
        *[("events", c) for c in ("event_id", "user_id", "value")],
    ]
)


def negative_policy_query(spark, d):
    """Balances under three names: two are allowed to be negative."""
    customers = table(spark, d, "customer").select(
        F.col("c_acctbal").alias("revenue"),
        F.col("c_acctbal").alias("gross_profit"),
        F.col("c_acctbal").alias("discount_amount"),
        "c_custkey",
    )
    suppliers = table(spark, d, "supplier").select("s_acctbal", "s_suppkey")
    found = negative_policy(customers).unionByName(negative_policy(suppliers))
    return found.withColumn("negative_rate", F.round("negative_rate", 9))


def _negative_sql(source, column, name, allowed):
    warning = "NULL" if allowed else f"'Unexpected negative values in ''{name}'': ' || count(*) FILTER (WHERE {column} < 0) || ' occurrences'"
    return f"""SELECT '{name}' AS column_name, count(*) FILTER (WHERE {column} < 0) AS negative_count,
round(CAST(count(*) FILTER (WHERE {column} < 0) AS DOUBLE) / count({column}), 9) AS negative_rate, {str(allowed).lower()} AS is_allowed,
{warning} AS warning FROM {source} HAVING count(*) FILTER (WHERE {column} < 0) > 0"""


ORACLES["negative_policy"] = " UNION ALL ".join(
    [
        _negative_sql("customer", "c_acctbal", "revenue", False),
        _negative_sql("customer", "c_acctbal", "gross_profit", True),
        _negative_sql("customer", "c_acctbal", "discount_amount", True),
        _negative_sql("supplier", "s_acctbal", "s_acctbal", False),
    ]
)


def column_kinds_query(spark, d):
    lines = column_kinds(table(spark, d, "lineitem"))
    customers = column_kinds(table(spark, d, "customer"))
    return lines.unionByName(customers).select("column_name", "kind")


ORACLES["column_kinds"] = " UNION ALL ".join(
    [
        f"SELECT '{c}' AS column_name, {k} AS kind"
        for c, k in {
            **{c: "'value'" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")},
            **{c: "'value'" for c in ("l_extendedprice", "l_discount", "l_tax", "c_custkey", "c_nationkey", "c_acctbal")},
            "l_shipdate": "'time'",
        }.items()
    ]
    + [
        f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) < count({c}) * 0.5 THEN 'group' ELSE 'other' END FROM {t}"
        for t, c in [("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("customer", "c_name"), ("customer", "c_mktsegment")]
    ]
)


def dataset_metadata_query(spark, d):
    """Row, column and currency facts of the cleaned orders, and the steps taken."""
    from topshare.functions.naming import standard_names

    raw = _messy_orders(spark, d)
    names = standard_names(raw.columns)
    renamed = raw.toDF(*names)
    # One row per column, used three times.
    steps, _path = materialize(cascade(renamed, names), "cascade")
    data = apply_plans(renamed, plans_from(steps.orderBy("position")))
    joined = one_row(dataset_metadata(data, profile(data), steps), transformation_summary(steps))
    return joined.select(
        *[F.array_join(c, "|").alias(c) if c in ("currencies_detected", "transformation_types") else F.col(c) for c in joined.columns]
    )


ORACLES["dataset_metadata"] = """SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count, true AS has_time_dimension,
'$|CHF|€' AS currencies_detected, true AS multi_currency, CAST(7 AS BIGINT) AS total_transformations, CAST(6 AS BIGINT) AS columns_modified,
'boolean_coercion|datetime_coercion|header_standardization|numeric_coercion|percent_normalization|percent_representation' AS transformation_types
FROM orders"""

def dataset_schema(spark, d):
    """The stored description of the customers, from a raw text table."""
    balance = F.format_number(F.abs("c_acctbal"), 2)
    raw = table(spark, d, "customer", spread=True).select(
        F.col("c_custkey").cast("string").alias("Customer Key"),
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit("($"), balance, F.lit(")")))
        .otherwise(F.concat(F.lit("$"), balance))
        .alias("Balance (USD)"),
        F.col("c_mktsegment").alias("Segment"),
    )
    result = normalize(raw)
    return column_schema(result.data, result).select(
        "name",
        "original_name",
        "dtype",
        "role",
        "cardinality",
        "null_rate",
        "coercions.currency_removed",
        "coercions.parentheses_to_negative",
        F.array_join("currencies_detected", "|").alias("currencies"),
        F.coalesce("anomalies.low_cardinality", F.lit(False)).alias("low_cardinality"),
    )


def _schema_row(name, original, dtype, column, numeric, money=False):
    role = (
        f"CASE WHEN count(DISTINCT {column}) > least(50, greatest(5, count(*) // 10)) OR count(DISTINCT {column}) > count(*) * 0.5 "
        "THEN 'numeric' ELSE 'categorical' END"
        if numeric
        else "'categorical'"
    )
    counts = "count(*)" if money else "count(*) * 0"
    negatives = "count(*) FILTER (WHERE c_acctbal < 0)" if money else "count(*) * 0"
    return f"""SELECT '{name}' AS name, '{original}' AS original_name, '{dtype}' AS dtype, {role} AS role, count(DISTINCT {column}) AS cardinality,
CAST(0 AS DOUBLE) AS null_rate, {counts} AS currency_removed, {negatives} AS parentheses_to_negative, '{'$' if money else ''}' AS currencies,
count(*) > 100 AND count(DISTINCT {column}) < 5 AS low_cardinality FROM customer"""


ORACLES["dataset_schema"] = " UNION ALL ".join(
    [
        _schema_row("customer_key", "Customer Key", "bigint", "c_custkey", True),
        _schema_row("balance_usd", "Balance (USD)", "double", "c_acctbal", True, money=True),
        _schema_row("segment", "Segment", "string", "c_mktsegment", False),
        _schema_row("period_key", "period_key", "string", "CAST('ALL' AS VARCHAR)", False),
    ]
)

for _name in list(ORACLES):
    QUERIES[_name] = globals().get(f"{_name}_query") or globals()[_name]
