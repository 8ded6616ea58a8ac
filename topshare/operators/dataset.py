"""The stored description of a cleaned table, and the whole way from raw to stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topshare.operators import audit
from topshare.operators.normalize import BOOLEAN, DATETIME, NUMERIC, PERCENT, STEPS, Normalized, normalize
from topshare.operators.profile import negative_policy, numeric_columns, profile
from topshare.sources import files

_COERCIONS = {
    "currency_removed": NUMERIC,
    "parentheses_to_negative": NUMERIC,
    "scaling_applied": NUMERIC,
    "unicode_minus_normalized": NUMERIC,
    "percent_normalized": PERCENT,
    "datetime_parsed": DATETIME,
    "boolean_coerced": BOOLEAN,
    "failed_numeric_coercions": NUMERIC,
}


def column_schema(data: DataFrame, result: Normalized) -> DataFrame:
    """One row per column of ``data`` (the cleaned table, best read back from where it was written).

    name, original_name, dtype, role, cardinality, null_rate, coercions, representation,
    anomalies, decimal_convention, currencies_detected, multi_currency.
    """
    facts = []
    for p in result.plans:
        counters = [p.counters.get(c, 0) if p.branch == step else 0 for c, step in _COERCIONS.items()]
        facts.append((p.name, p.original_name, p.representation, p.decimal_convention, p.currencies, *counters))
    known = {f[0] for f in facts}
    facts += [(c, c, None, None, [], *[0] * len(_COERCIONS)) for c in data.columns if c not in known]
    counts = ", ".join(f"{c} bigint" for c in _COERCIONS)
    plans = data.sparkSession.createDataFrame(
        facts,
        "column_name string, original_name string, representation string, decimal_convention string, "
        f"currencies_detected array<string>, {counts}",
    )
    flag = lambda name: F.when(F.col(name), F.lit(True)).alias(name)
    some = F.col("outlier_count") > 0
    return (
        profile(data)
        .join(plans, "column_name")
        .select(
            "position",
            F.col("column_name").alias("name"),
            "original_name",
            "dtype",
            "role",
            "cardinality",
            "null_rate",
            F.struct(*_COERCIONS).alias("coercions"),
            "representation",
            F.struct(
                "null_count",
                "null_rate",
                "cardinality",
                flag("high_null_rate"),
                flag("low_cardinality"),
                F.when(some, F.col("outlier_count")).alias("outlier_count"),
                F.when(some, F.col("outlier_rate")).alias("outlier_rate"),
            ).alias("anomalies"),
            "decimal_convention",
            "currencies_detected",
            (F.size("currencies_detected") > 1).alias("multi_currency"),
            "n_rows",
        )
    )


def schema_document(data: DataFrame, result: Normalized, dataset_id: str) -> DataFrame:
    """One row: the columns (a list as long as the table is wide), time facts, metadata, warnings, steps."""
    columns = column_schema(data, result)
    fields = [c for c in columns.columns if c not in ("position", "n_rows")]
    listed = F.array_sort(F.collect_list(F.struct("position", F.struct(*fields).alias("column"))))
    texts = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    currencies = sorted({c for p in result.plans for c in p.currencies})
    used = [p.branch for p in result.plans if p.branch in STEPS]
    document = columns.agg(
        F.transform(listed, lambda x: x["column"]).alias("columns"),
        F.max("n_rows").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.max(F.col("role") == "datetime").alias("has_time_dimension"),
    )
    warnings = texts(result.warnings)
    if numeric_columns(data):
        # At most one warning per numeric column.
        found = negative_policy(data).agg(F.array_sort(F.collect_list("warning")).alias("negatives"))
        negatives = found.first()["negatives"]
        warnings = texts([*result.warnings, *negatives])
    return document.select(
        F.lit(dataset_id).alias("dataset_id"),
        "columns",
        F.lit(result.time.grain).alias("period_grain"),
        texts(result.time.grain_candidates).alias("period_grain_candidates"),
        texts(result.time.candidates).alias("time_candidates"),
        F.struct(
            "row_count",
            "column_count",
            F.lit(len(currencies) > 1).alias("multi_currency"),
            texts(currencies).alias("currencies_detected"),
            "has_time_dimension",
        ).alias("metadata"),
        warnings.alias("warnings"),
        F.struct(
            F.lit(len(used) + 1).alias("total_transformations"),
            F.lit(len(used)).alias("columns_modified"),
            texts(sorted({*used, "header_standardization"})).alias("transformation_types"),
        ).alias("transformations_summary"),
    )


def normalize_and_store(raw: DataFrame, dataset_id: str, path: str, source: str = "raw") -> DataFrame:
    """Clean ``raw`` and write data, schema and lineage under ``path`` (this starts jobs).

    Returns the cleaned table, read back.  Layout: data/ (Parquet, one folder
    per dataset), schema/ and lineage/ (JSON, appended, partitioned by dataset).
    """
    spark = raw.sparkSession
    result = normalize(raw)
    target = f"{path}/data/{dataset_id}"
    manifest = files.write_parquet(result.data, target)
    data = spark.read.schema(result.data.schema).parquet(target)
    files.append_records(schema_document(data, result, dataset_id), f"{path}/schema")
    # One figure stands for all files.
    digest = files.combined_digest(manifest).first()["files_digest"]
    steps = result.transformations()
    files.append_records(
        audit.lineage_step(
            raw,
            dataset_id,
            "normalize",
            [source],
            ["data", "schema"],
            {"original_columns": len(raw.columns), "normalized_columns": len(data.columns)},
            {
                "transformations_applied": len(steps),
                "warnings_generated": len(result.warnings),
                "columns_modified": len(steps) - 1,
                "parquet_checksum": digest,
            },
        ),
        f"{path}/lineage",
    )
    return data
