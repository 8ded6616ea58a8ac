"""Write the standard set of samples of a table, with a manifest."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topshare.operators import sampling
from topshare.operators.profile import column_kinds, one_row
from topshare.sources import files


def chosen_columns(df: DataFrame, keys: Sequence[str] = ()) -> dict[str, str | None]:
    """group, value and period as the samplers choose them (this starts a job); keys are left out.

    The first column with repeated texts, the first measure, the last time column.
    """
    # One row per column.
    found = sorted((r["position"], r["kind"], r["column_name"]) for r in column_kinds(df).collect())
    named = {kind: [c for _, k, c in found if k == kind and c not in keys] for kind in ("group", "value", "time")}
    first = {kind: next(iter(names), None) for kind, names in named.items()}
    return {"group": first["group"], "value": first["value"], "period": named["time"][-1] if named["time"] else None}


def write_samples(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    group: str | None = None,
    value: str | None = None,
    period: str | None = None,
    seed: int = 42,
    choose: bool = False,
) -> DataFrame:
    """Write each sample under ``path`` (this starts jobs) and return the manifest.

    ``choose`` takes columns that are not given from :func:`chosen_columns`;
    samples without their columns are left out.

    Manifest: name, description, n_rows, checksum (of the rows), n_columns,
    n_files, files_digest.  ``files.file_manifest`` lists the files.
    """
    spark = df.sparkSession
    if choose:
        picked = chosen_columns(df, keys)
        group, value, period = group or picked["group"], value or picked["value"], period or picked["period"]
    columns = len(df.columns)
    random = sampling.random_samples(df, keys, [20, 10, 8, 5], seed)
    samples: dict[str, tuple[str, DataFrame]] = {
        "sample_20pct": ("20% random sample", random[20]),
        "sample_small": ("5% random sample", random[5]),
    }
    if period:
        balanced = sampling.time_balanced_sample(df, period, keys, 10, seed)
        samples["sample_time_balanced"] = ("ten rows of every period", balanced)
    if group and value:
        top = sampling.top_entities_sample(df, group, value, 10)
        samples["sample_top_entities"] = ("all rows of the top ten entities", top)
    kept = [*keys, *[c for c in (period, group) if c]]
    edge = sampling.edge_cases_sample(
        df, keys, [value] if value else [], [group] if group else [], preserve=kept, seed=seed
    )
    samples["sample_edge_cases"] = ("nulls, extremes and special characters", edge)
    if group:
        samples["sample_stratified"] = ("15% of every group", sampling.stratified_sample(df, group, keys, 15, seed))
    targets = [c for c in df.columns if c not in kept]
    gappy = sampling.add_random_nulls(random[10], keys, 12, targets, seed)
    samples["sample_with_nulls"] = ("10% sample with 12% nulls", gappy)
    if value:
        holed = sampling.add_column_nulls(random[8], value, keys, 25, seed=seed)
        samples["sample_single_null_column"] = (f"8% sample with 25% nulls in {value}", holed)

    lines = []
    for name, (text, sample) in samples.items():
        target = f"{path}/{name}"
        sample.write.parquet(target)
        listed = files.combined_digest(files.file_manifest(spark, target, "*.parquet"))
        counted = files.table_checksum(spark.read.schema(sample.schema).parquet(target))
        lines.append(
            one_row(counted, listed).select(
                F.lit(name).alias("name"),
                F.lit(text).alias("description"),
                "n_rows",
                "checksum",
                F.lit(columns).cast("bigint").alias("n_columns"),
                "n_files",
                "files_digest",
            )
        )
    return reduce(DataFrame.unionByName, lines)
