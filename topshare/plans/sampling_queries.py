"""Samples and null injection over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topshare.operators import sampling
from topshare.operators.numbering import number_rows
from topshare.plans.common import table

QUERIES, ORACLES = {}, {}
_KEY = ["o_orderkey"]
_HASH = "md5('42|' || length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey)"


def sample_random(spark, d):
    return sampling.random_sample(table(spark, d, "orders"), _KEY, 20.0)


ORACLES["sample_random"] = f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
SELECT *, row_number() OVER (ORDER BY {_HASH}) AS pos, count(*) OVER () AS n FROM orders) t WHERE pos <= floor(n * 0.2)"""


def sample_random_sizes(spark, d):
    """Five samples of one hash order, found in one count of the rows."""
    events = table(spark, d, "events").select("event_id", "user_id", "value")
    found = sampling.random_samples(events, ["event_id"], [50.0, 20.0, 8.0, 1.0, 0.0])
    return reduce(DataFrame.unionByName, [rows.withColumn("percentage", F.lit(p)) for p, rows in found.items()])


ORACLES["sample_random_sizes"] = """WITH t AS (SELECT event_id, user_id, value, count(*) OVER () AS n,
row_number() OVER (ORDER BY md5('42|' || length(CAST(event_id AS VARCHAR)) || ':' || event_id)) AS pos FROM events)
SELECT event_id, user_id, value, CAST(p AS DOUBLE) AS percentage
FROM t, (VALUES (50), (20), (8), (1), (0)) v(p) WHERE pos <= floor(n * p / 100)"""


def sample_time_balanced(spark, d):
    orders = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return sampling.time_balanced_sample(orders, "year", _KEY, 10).select("year", "o_orderkey", "o_totalprice")


ORACLES["sample_time_balanced"] = f"""SELECT CAST(year AS INTEGER) AS year, o_orderkey, o_totalprice FROM (
SELECT *, year(o_orderdate) AS year, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY {_HASH}, o_orderkey) AS pos FROM orders) t
WHERE pos <= 10"""


def sample_top_entities(spark, d):
    orders = table(spark, d, "orders")
    return sampling.top_entities_sample(orders, "o_custkey", "o_totalprice", 10).select("o_orderkey", "o_custkey", "o_totalprice")


ORACLES["sample_top_entities"] = """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (
SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY sum(CAST(o_totalprice AS DECIMAL(18, 6))) DESC, o_custkey LIMIT 10)"""


def top_entity_totals(spark, d):
    top = sampling.top_entities(table(spark, d, "lineitem"), "l_partkey", "l_extendedprice", 25)
    return top.withColumn("total_value", F.round(F.col("total_value").cast("double"), 2))


ORACLES["top_entity_totals"] = """SELECT l_partkey, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 6))) AS DOUBLE), 2) AS total_value
FROM lineitem GROUP BY l_partkey ORDER BY sum(CAST(l_extendedprice AS DECIMAL(18, 6))) DESC, l_partkey LIMIT 25"""


def sample_stratified(spark, d):
    return sampling.stratified_sample(table(spark, d, "orders"), "o_orderpriority", _KEY, 15.0).select(
        "o_orderkey", "o_orderpriority"
    )


ORACLES["sample_stratified"] = f"""SELECT o_orderkey, o_orderpriority FROM (
SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_HASH}) AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS n
FROM orders) t WHERE pos <= round_even(n * 0.15, 0)"""


def sample_stratified_small_groups(spark, d):
    """Groups of about ten rows: many quotas are halves or round to nothing."""
    return sampling.stratified_sample(table(spark, d, "orders"), "o_custkey", _KEY, 10.0).select("o_orderkey", "o_custkey")


ORACLES["sample_stratified_small_groups"] = f"""SELECT o_orderkey, o_custkey FROM (
SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {_HASH}) AS pos, count(*) OVER (PARTITION BY o_custkey) AS n
FROM orders) t WHERE pos <= round_even(n * 0.1, 0)"""


def sample_stratified_uneven(spark, d):
    """One group holds a third of the rows, thousands hold a few: large ones are decided where they are read."""
    group = F.when(F.col("o_orderkey") % 3 == 0, F.lit(-1)).otherwise(F.col("o_custkey"))
    orders = table(spark, d, "orders").select("o_orderkey", group.alias("g"))
    return sampling.stratified_sample(orders, "g", _KEY, 15.0, most_broadcast=20)


ORACLES["sample_stratified_uneven"] = f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS g FROM orders)
SELECT o_orderkey, g FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {_HASH}) AS pos, count(*) OVER (PARTITION BY g) AS n
FROM t) u WHERE pos <= round_even(n * 0.15, 0)"""


def sample_edge_cases(spark, d):
    """Orders whose status is missing for every 500th key."""
    orders = table(spark, d, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.when(F.col("o_orderkey") % 500 != 7, F.col("o_orderstatus")).alias("status"),
        "o_orderpriority",
    )
    return sampling.edge_cases_sample(orders, _KEY, ["o_totalprice"], ["status", "o_orderpriority"])


ORACLES["sample_edge_cases"] = """WITH o AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 500 <> 7 THEN o_orderstatus END AS status, o_orderpriority FROM orders)
SELECT * FROM (SELECT * FROM o WHERE status IS NULL ORDER BY o_orderkey LIMIT 5)
UNION SELECT * FROM (SELECT * FROM o ORDER BY o_totalprice, o_orderkey LIMIT 2)
UNION SELECT * FROM (SELECT * FROM o ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)
UNION SELECT * FROM (SELECT * FROM o WHERE regexp_matches(status, '[^\\w\\s]') ORDER BY o_orderkey LIMIT 3)
UNION SELECT * FROM (SELECT * FROM o WHERE regexp_matches(o_orderpriority, '[^\\w\\s]') ORDER BY o_orderkey LIMIT 3)"""


def inject_nulls(spark, d):
    return sampling.add_random_nulls(table(spark, d, "orders"), _KEY, 12.0)


_NULLS = "row_number() OVER (ORDER BY md5('42|{0}|' || length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey))"
_NULLED = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORACLES["inject_nulls"] = (
    "SELECT o_orderkey, "
    + ", ".join(f"CASE WHEN r_{c} > k THEN {c} END AS {c}" for c in _NULLED)
    + " FROM (SELECT *, "
    + ", ".join(f"{_NULLS.format(c)} AS r_{c}" for c in _NULLED)
    + ", greatest(1, floor(count(*) OVER () * 12.0 / 100)) AS k FROM orders) t"
)


def inject_nulls_patterns(spark, d):
    """Which rows each pattern of a single column hits."""
    orders = table(spark, d, "orders")
    parts = [
        sampling.add_column_nulls(orders, "o_totalprice", _KEY, 7.0, pattern)
        .where(F.col("o_totalprice").isNull())
        .select(F.lit(pattern).alias("pattern"), "o_orderkey")
        for pattern in ("random", "first_n", "last_n", "every_nth")
    ]
    return reduce(DataFrame.unionByName, parts)


ORACLES["inject_nulls_patterns"] = """WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n,
row_number() OVER (ORDER BY md5('42|o_totalprice|' || length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey)) AS h, CAST(greatest(1, floor(count(*) OVER () * 7.0 / 100)) AS BIGINT) AS k FROM orders)
SELECT 'random' AS pattern, o_orderkey FROM t WHERE h <= k
UNION ALL SELECT 'first_n', o_orderkey FROM t WHERE rn <= k
UNION ALL SELECT 'last_n', o_orderkey FROM t WHERE rn > n - k
UNION ALL SELECT 'every_nth', o_orderkey FROM t WHERE (rn - 1) % greatest(1, n // k) = 0 AND (rn - 1) // greatest(1, n // k) < k"""


def sample_composite_key(spark, d):
    """A sample by two text keys whose joined texts would be ambiguous."""
    lines = table(spark, d, "lineitem").select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("|")).alias("a"),
        F.concat(F.lit("|"), F.col("l_linenumber").cast("string")).alias("b"),
        "l_quantity",
    )
    return sampling.random_sample(lines, ["a", "b"], 10.0)


ORACLES["sample_composite_key"] = """WITH t AS (SELECT l_orderkey || '|' AS a, '|' || l_linenumber AS b, l_quantity FROM lineitem)
SELECT a, b, l_quantity FROM (SELECT *, count(*) OVER () AS n,
row_number() OVER (ORDER BY md5('42|' || length(a) || ':' || a || '|' || length(b) || ':' || b)) AS pos FROM t) u WHERE pos <= floor(n * 0.1)"""


def sample_edge_cases_nan(spark, d):
    """NaN is a missing value: such rows count as rows with nulls and are no extremes."""
    orders = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 400 == 3, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"),
    )
    found = sampling.edge_cases_sample(orders, _KEY, ["price"])
    return found.withColumn("price", F.nanvl("price", F.lit(None).cast("double")))


ORACLES["sample_edge_cases_nan"] = """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 400 <> 3 THEN o_totalprice END AS price FROM orders)
SELECT * FROM (SELECT * FROM o WHERE price IS NULL ORDER BY o_orderkey LIMIT 5)
UNION SELECT * FROM (SELECT * FROM o WHERE price IS NOT NULL ORDER BY price, o_orderkey LIMIT 2)
UNION SELECT * FROM (SELECT * FROM o WHERE price IS NOT NULL ORDER BY price DESC, o_orderkey LIMIT 2)"""


def row_numbers_by_ranges(spark, d):
    """Row numbers per customer by date, through range partitioning."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    order = [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()]
    return number_rows(orders, order, ["o_custkey"], max_window_rows=0).select("o_orderkey", "row_no")


ORACLES["row_numbers_by_ranges"] = """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS row_no FROM orders"""


def rows_with_nulls(spark, d):
    """Any-null predicate over derived nulls, counted by status."""
    orders = table(spark, d, "orders").select(
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_custkey")).alias("a"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("b"),
    )
    return orders.where(sampling.has_null(orders)).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


ORACLES["rows_with_nulls"] = """SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 10 = 0 GROUP BY o_orderstatus"""

for _name in list(ORACLES):
    QUERIES[_name] = globals()[_name]
