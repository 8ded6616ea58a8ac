"""Round trips through the file formats, in the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from topshare.operators import report
from topshare.operators.concentration import concentrate
from topshare.operators.normalize import apply_plans, plan_normalization
from topshare.plans.common import METRICS_SQL, concentration_sql, metrics, table
from topshare.session import scratch_path
from topshare.sources import digests, files
from topshare.sources.csv_records import read_csv_records

QUERIES, ORACLES = {}, {}
_PRIORITY_SOURCE = "SELECT o_custkey AS entity, o_orderpriority AS period, o_totalprice AS value FROM orders"


def csv_round_trip(spark, d):
    """Orders as CSV; the cleaning rules give the types back."""
    path = scratch_path(spark, "csv")
    files.write_csv(table(spark, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")), path)
    raw = files.read_csv(spark, path)
    return apply_plans(raw, plan_normalization(raw)).withColumn("o_orderdate", F.col("o_orderdate").cast("date").cast("string"))


ORACLES["csv_round_trip"] = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
o_orderpriority FROM orders"""


def csv_quoted_text(spark, d):
    """Whole texts with quotes, commas and line breaks through a CSV file, and ids of 19 digits through the cleaning rules."""
    path = scratch_path(spark, "csv-text")
    long_id = (F.lit(1234567890123450000) + F.col("doc_id")).cast("string")
    texts = table(spark, d, "documents").select("doc_id", long_id.alias("long_id"), F.concat(F.lit('"a", '), "text").alias("text"))
    files.write_csv(texts, path)
    raw = files.read_csv(spark, path, multiLine=True)
    clean = apply_plans(raw.select("doc_id", "long_id"), plan_normalization(raw.select("doc_id", "long_id")))
    ids = clean.withColumn("long_id", F.col("long_id").cast("bigint"))
    whole = raw.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.char_length("text").alias("n"), F.md5("text").alias("text_md5"))
    return whole.join(ids, "doc_id")


ORACLES["csv_quoted_text"] = """SELECT doc_id, CAST(length('"a", ' || text) AS INTEGER) AS n, md5('"a", ' || text) AS text_md5,
1234567890123450000 + doc_id AS long_id FROM documents"""


def csv_quoted_records(spark, d):
    """Whole texts with quotes, commas and line breaks, read back by every task that the files have splits for."""
    path = scratch_path(spark, "csv-records-text")
    texts = table(spark, d, "documents").select("doc_id", F.concat(F.lit('"a",\r\n ""'), "text").alias("the text"), "lang")
    files.write_csv(texts.repartition(2), path)
    raw = read_csv_records(spark, path)
    return raw.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.char_length("the text").alias("n"), F.md5("the text").alias("text_md5"), "lang"
    )


ORACLES["csv_quoted_records"] = """SELECT doc_id, CAST(length(t) AS INTEGER) AS n, md5(t) AS text_md5, lang
FROM (SELECT doc_id, lang, '"a",' || chr(13) || chr(10) || ' ""' || text AS t FROM documents)"""



def parquet_round_trip(spark, d):
    """Three columns of the line items, written and read by column list."""
    path = scratch_path(spark, "parquet")
    files.write_parquet(table(spark, d, "lineitem"), path, checksums=False, compression="zstd")
    lines = files.read_parquet(spark, path, ["l_returnflag", "l_orderkey", "l_quantity"])
    return lines.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"), F.sum("l_quantity").alias("quantity")
    )


ORACLES["parquet_round_trip"] = """SELECT l_returnflag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, sum(l_quantity) AS quantity
FROM lineitem GROUP BY l_returnflag"""


def parquet_checksum(spark, d):
    """Checksums of orders as written to Parquet and read again, and of a part of the rows."""
    path = scratch_path(spark, "checked")
    files.write_parquet(table(spark, d, "orders").repartition(3), path, checksums=False, compression="zstd")
    stored = files.read_parquet(spark, path)
    whole = files.table_checksum(stored).withColumn("rows", F.lit("all"))
    return whole.unionByName(files.table_checksum(stored.where("o_orderkey % 3 = 0")).withColumn("rows", F.lit("third")))


_ROW_MD5 = """md5('{"o_custkey":' || o_custkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') ||
'","o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus ||
'","o_totalprice":' || o_totalprice || '}')"""
ORACLES["parquet_checksum"] = f"""WITH r AS (SELECT o_orderkey, CAST('0x' || substr({_ROW_MD5}, 1, 12) AS BIGINT) AS part FROM orders)
SELECT 'all' AS rows, count(*) AS n_rows, CAST(sum(part) AS VARCHAR) AS checksum FROM r
UNION ALL SELECT 'third', count(*), CAST(sum(part) AS VARCHAR) FROM r WHERE o_orderkey % 3 = 0"""


def json_round_trip(spark, d):
    """Nested result documents as JSON, read with a declared schema."""
    path = scratch_path(spark, "json")
    documents = report.result_documents(concentrate(table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderpriority"))
    files.write_json(documents, path)
    figures = "struct<count:bigint,value:double,percentage:double,entities:array<bigint>>"
    schema = f"is_total boolean, period string, total_entities bigint, total_value double, concentration map<string,{figures}>"
    stored = files.read_json(spark, path, schema)
    opened = stored.select("is_total", "period", F.explode("concentration").alias("threshold", "f"))
    return opened.select(
        "is_total",
        "period",
        F.substring("threshold", 5, 3).cast("int").alias("threshold"),
        F.col("f.count").alias("entity_count"),
        F.round("f.value", 2).alias("value"),
        F.round("f.percentage", 6).alias("pct"),
    )


ORACLES["json_round_trip"] = concentration_sql(_PRIORITY_SOURCE) + METRICS_SQL


def report_csv_round_trip(spark, d):
    """The report as one CSV file, read back as text."""
    path = scratch_path(spark, "report")
    result = concentrate(table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderpriority")
    files.write_csv(report.sorted_report(result), path, single_file=True)
    back = files.read_csv(spark, path)
    return back.select(
        F.col("is_total").cast("boolean").alias("is_total"),
        "period",
        F.col("threshold").cast("int").alias("threshold"),
        F.col("count").cast("bigint").alias("count"),
        F.round(F.col("value").cast("double"), 2).alias("value"),
        F.col("pct_of_total").cast("double").alias("pct_of_total"),
        "group_by",
    )


ORACLES["report_csv_round_trip"] = (
    concentration_sql(_PRIORITY_SOURCE)
    + """SELECT is_total, period, threshold, entity_count AS "count", round(value, 2) AS value, round(pct, 1) AS pct_of_total,
'o_custkey' AS group_by FROM m"""
)


def appended_records(spark, d):
    """Metadata records appended in two batches, partitioned by dataset."""
    path = scratch_path(spark, "records")
    events = table(spark, d, "events").select(
        F.col("event_type").alias("dataset_id"), F.col("event_id").alias("record"), F.col("value")
    )
    files.append_records(events.where(F.col("record") % 2 == 0), path)
    files.append_records(events.where(F.col("record") % 2 == 1), path)
    stored = files.read_json(spark, path, "record bigint, value double, dataset_id string")
    return stored.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("record").alias("records"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("value")
    )


ORACLES["appended_records"] = """SELECT event_type AS dataset_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS records,
round(CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE), 2) AS value FROM events GROUP BY event_type"""


def normalized_metrics(spark, d):
    """CSV in, cleaned, analyzed: the whole way."""
    path = scratch_path(spark, "raw")
    orders = table(spark, d, "orders")
    raw = orders.select(
        F.col("o_custkey").cast("string").alias("Customer Key"),
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("Total (USD)"),
        F.year("o_orderdate").cast("string").alias("Year"),
        F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("Quarter"),
    )
    files.write_csv(raw, path)
    from topshare.operators.normalize import normalize

    cleaned = normalize(files.read_csv(spark, path))
    return metrics(concentrate(cleaned.data, "customer_key", "total_usd", "period_key"))


ORACLES["normalized_metrics"] = (
    concentration_sql(
        "SELECT o_custkey AS entity, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS period, o_totalprice AS value FROM orders"
    )
    + METRICS_SQL
)


def file_manifest(spark, d):
    """Name, size and SHA-256 of every table file (no SQL: the views do not show their files)."""
    manifest = files.file_manifest(spark, d, "*.parquet")
    return manifest.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256").orderBy("name")


_BLOCK, _FAN = 4096, 8


def _order_lines(spark, d) -> str:
    """The orders as text, one file for each priority, in order of their keys; returns the folder."""
    path = scratch_path(spark, "lines")
    line = F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd"))
    lines = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), "o_orderkey", line.alias("line"))
    ordered = lines.repartition("p").sortWithinPartitions("p", "o_orderkey")
    ordered.select("p", "line").write.partitionBy("p").text(path)
    return path


def _priority():
    """The priority of a file, from the folder it lies in."""
    return F.regexp_extract(F.col("path"), "/p=([^/]*)/", 1).alias("priority")


_LINES_SQL = """WITH f AS (SELECT o_orderpriority AS priority, string_agg(o_orderkey || ',' || o_custkey || ',' || o_orderstatus || ',' ||
strftime(o_orderdate, '%Y-%m-%d') || chr(10), '' ORDER BY o_orderkey) AS content FROM orders GROUP BY o_orderpriority)"""


def file_digests(spark, d):
    """Size and SHA-256 of the files with the orders of each priority."""
    return files.file_manifest(spark, _order_lines(spark, d), "*.txt").select(_priority(), "length", "sha256")


ORACLES["file_digests"] = _LINES_SQL + " SELECT priority, length(content) AS length, sha256(content) AS sha256 FROM f"


def file_blocks(spark, d):
    """Digests of the blocks of these files."""
    blocks = digests.block_digests(spark, _order_lines(spark, d), "*.txt", _BLOCK)
    return blocks.select(_priority(), "block", "start", "length", "sha256")


_BLOCKS_SQL = _LINES_SQL + f""", b AS (SELECT priority, block, block * {_BLOCK} AS start, substr(content, block * {_BLOCK} + 1, {_BLOCK}) AS bytes
FROM (SELECT *, unnest(range(CAST(ceil(length(content) / {_BLOCK}) AS BIGINT))) AS block FROM f))"""
ORACLES["file_blocks"] = _BLOCKS_SQL + " SELECT priority, block, start, length(bytes) AS length, sha256(bytes) AS sha256 FROM b"


def file_trees(spark, d):
    """The tree of digests over the blocks of these files, down from its roots to level 1."""
    path = _order_lines(spark, d)
    longest = digests.list_files(spark, path, "*.txt").agg(F.max("length")).first()[0] or 0
    blocks = digests.block_digests(spark, path, "*.txt", _BLOCK)
    tree = digests.digest_trees(blocks, -(-longest // _BLOCK), _FAN)
    top = digests.roots(tree)
    return tree.where("level > 0").join(top, "path").select(
        _priority(), "level", "node", "sha256", (F.col("sha256") == F.col("root")).alias("is_root")
    )


def _level_sql(level: int) -> str:
    return f"""l{level} AS (SELECT priority, node // {_FAN} AS node, sha256(string_agg(sha256, '' ORDER BY node)) AS sha256
FROM l{level - 1} GROUP BY priority, node // {_FAN})"""


_LEVELS = 10  # 8 ** 10 blocks: more than any table here has
ORACLES["file_trees"] = (
    _BLOCKS_SQL
    + ", l0 AS (SELECT priority, block AS node, sha256(bytes) AS sha256 FROM b), "
    + ", ".join(_level_sql(n) for n in range(1, _LEVELS + 1))
    + ", longest AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM l0 GROUP BY priority)), "
    + "levels AS ("
    + " UNION ALL ".join(f"SELECT {n} AS level, * FROM l{n}" for n in range(1, _LEVELS + 1))
    + f""") SELECT priority, level, node, sha256,
level = greatest(1, (SELECT CAST(ceil(round(ln(n) / ln({_FAN}), 9)) AS INTEGER) FROM longest)) AS is_root
FROM levels WHERE level <= greatest(1, (SELECT CAST(ceil(round(ln(n) / ln({_FAN}), 9)) AS INTEGER) FROM longest))"""
)


def fixture_manifest(spark, d):
    """Three samples written as Parquet, with rows, columns and checksums."""
    from topshare.sources.fixtures import write_samples

    orders = table(spark, d, "orders")
    manifest = write_samples(
        orders, scratch_path(spark, "samples"), ["o_orderkey"], group="o_orderpriority", value="o_totalprice", period="o_orderdate"
    )
    return manifest.select("name", "n_rows", "n_columns")


ORACLES["fixture_manifest"] = """SELECT 'sample_20pct' AS name, CAST(floor(count(*) * 0.2) AS BIGINT) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM orders
UNION ALL SELECT 'sample_small', CAST(floor(count(*) * 0.05) AS BIGINT), 6 FROM orders
UNION ALL SELECT 'sample_time_balanced', CAST(sum(least(n, 10)) AS BIGINT), 6 FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderdate)
UNION ALL SELECT 'sample_top_entities', count(*), 6 FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC LIMIT 10)
UNION ALL SELECT 'sample_edge_cases', count(*), 6 FROM (
  SELECT * FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 2)
  UNION SELECT * FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)
  UNION SELECT * FROM (SELECT * FROM orders WHERE regexp_matches(o_orderpriority, '[^\\w\\s]') ORDER BY o_orderkey LIMIT 3))
UNION ALL SELECT 'sample_stratified', CAST(sum(round_even(n * 0.15, 0)) AS BIGINT), 6 FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)
UNION ALL SELECT 'sample_with_nulls', CAST(floor(count(*) * 0.1) AS BIGINT), 6 FROM orders
UNION ALL SELECT 'sample_single_null_column', CAST(floor(count(*) * 0.08) AS BIGINT), 6 FROM orders"""

for _name in [*ORACLES, "file_manifest"]:
    QUERIES[_name] = globals()[_name]
