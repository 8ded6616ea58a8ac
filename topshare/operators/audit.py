"""Lineage steps, stored model answers ("artifacts") and checks of stored metadata."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topshare.functions import fixed
from topshare.operators.numbering import number_rows

LINEAGE_SCHEMA = (
    "dataset_id string, timestamp timestamp, operation string, inputs array<string>, outputs array<string>, "
    "params map<string,string>, metrics map<string,string>"
)
ARTIFACT_SCHEMA = (
    "function_name string, request_id string, dataset_id string, timestamp timestamp, model string, provider string, "
    "context_hash string, response string, latency_ms bigint, usage map<string,bigint>, cached boolean, error string"
)


def lineage_step(
    df: DataFrame,
    dataset_id: str,
    operation: str,
    inputs: Sequence[str] = (),
    outputs: Sequence[str] = (),
    params: dict | None = None,
    metrics: dict | None = None,
) -> DataFrame:
    """One step as a row; :func:`append_steps` numbers it for good, :func:`numbered_steps` when lineage is read."""
    texts = lambda d: {str(k): str(v) for k, v in (d or {}).items()}
    row = (dataset_id, operation, list(inputs), list(outputs), texts(params), texts(metrics))
    schema = ", ".join(p for p in LINEAGE_SCHEMA.split(", ") if not p.startswith("timestamp"))
    spark = df.sparkSession
    made = spark.createDataFrame([row], schema).withColumn("timestamp", F.current_timestamp())
    return made.select(*[p.split(" ")[0] for p in LINEAGE_SCHEMA.split(", ")])


def _step_order(tie_break: Sequence[str]) -> list[Column]:
    return [F.col("timestamp").asc(), *[F.col(c).asc() for c in tie_break]]


def _with_id(numbered: DataFrame) -> DataFrame:
    digits = F.col("step_no").cast("string")
    return numbered.withColumn(
        "id", F.concat(F.lit("st_"), F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0")))
    )


def numbered_steps(lineage: DataFrame, tie_break: Sequence[str] = ("operation",), **sizes) -> DataFrame:
    """Add step_no and id (st_0001 ..) per dataset in time order (this starts jobs)."""
    return _with_id(number_rows(lineage, _step_order(tie_break), ["dataset_id"], "step_no", **sizes))


def _complete_batches(spark: SparkSession, path: str) -> list[str]:
    """Names of the appends whose marks are complete; one per append."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/marks/batch=*/_SUCCESS")
    found = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done)
    return sorted(f.getPath().getParent().getName() for f in found or [])


def append_steps(steps: DataFrame, path: str, tie_break: Sequence[str] = ("operation",), **sizes) -> None:
    """Store steps with the numbers that follow those stored before (this starts jobs).

    Steps keep their number for good: those of one append are numbered in time
    order, after all of earlier appends.  Beside the steps each append stores a
    mark for each of its datasets, the last number given; the next append reads
    only marks, so its cost follows its own steps.  Marks are written last and
    readers take appends with complete marks only: one that failed leaves
    nothing to see and is simply run again.  One append at a time; any session
    may do the next.  Null dataset ids are a dataset of their own.
    """
    spark, batch = steps.sparkSession, f"batch={uuid.uuid4().hex}"
    numbered = number_rows(steps, _step_order(tie_break), ["dataset_id"], "step_no", **sizes)
    earlier = _complete_batches(spark, path)
    if earlier:
        marks = spark.read.parquet(*[f"{path}/marks/{b}" for b in earlier])
        last = marks.groupBy(F.col("dataset_id").alias("__dataset")).agg(F.max("last_no").alias("__last"))
        joined = numbered.join(last, F.col("dataset_id").eqNullSafe(F.col("__dataset")), "left")
        after = F.col("step_no") + F.coalesce(F.col("__last"), F.lit(0))
        numbered = joined.withColumn("step_no", after).drop("__dataset", "__last")
    _with_id(numbered).write.parquet(f"{path}/steps/{batch}")
    stored = spark.read.parquet(f"{path}/steps/{batch}")
    stored.groupBy("dataset_id").agg(F.max("step_no").alias("last_no")).write.parquet(f"{path}/marks/{batch}")


def stored_steps(spark: SparkSession, path: str) -> DataFrame:
    """All steps that :func:`append_steps` stored, with step_no and id; nothing is numbered again."""
    complete = _complete_batches(spark, path)
    if not complete:
        raise ValueError(f"no complete append under {path}")
    return spark.read.parquet(*[f"{path}/steps/{b}" for b in complete])


def _edge_step(steps: DataFrame, operation: str | None, pick, by: Sequence[str], extra: Sequence[str]) -> DataFrame:
    chosen = steps if operation is None else steps.where(F.col("operation") == operation)
    rest = [c for c in steps.columns if c not in extra]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    return chosen.groupBy(*extra).agg(pick(row, F.struct(*[F.col(c) for c in by])).alias("r")).select(*extra, "r.*")


def latest_step(steps: DataFrame, operation: str | None, order: Sequence[str] = ("step_no",)) -> DataFrame:
    """Each dataset's last step of an operation."""
    return _edge_step(steps, operation, F.max_by, order, ["dataset_id"])


def first_step(steps: DataFrame, operation: str | None, order: Sequence[str] = ("step_no",)) -> DataFrame:
    """Each dataset's first step of an operation."""
    return _edge_step(steps, operation, F.min_by, order, ["dataset_id"])


def normalization_summary(schemas: DataFrame, steps: DataFrame, order: Sequence[str] = ("step_no",)) -> DataFrame:
    """Stored schema joined to the dataset's first ``normalize`` step; datasets without one are left out."""
    step = first_step(steps, "normalize", order)
    taken = [c for c in step.columns if c != "dataset_id"]
    renamed = {"timestamp": "normalized_at", "id": "step_id"}
    return schemas.join(
        step.select("dataset_id", *[F.col(f"`{c}`").alias(renamed.get(c, c)) for c in taken]), "dataset_id"
    )


def artifact_usage(
    artifacts: DataFrame, by: Sequence[str] = ("dataset_id",), limit: int = fixed.MAX_CALLS_PER_DATASET
) -> DataFrame:
    """Calls, share answered from cache, failures and latency per group, against the call limit."""
    cached = F.when(F.col("cached"), 1).otherwise(0)
    return (
        artifacts.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("calls_made"),
            F.avg(cached).alias("cached_share"),
            F.count("error").alias("failures"),
            F.avg("latency_ms").alias("mean_latency_ms"),
            F.max("latency_ms").alias("max_latency_ms"),
        )
        .withColumn("max_calls", F.lit(limit).cast("bigint"))
        .withColumn("limit_reached", F.col("calls_made") >= limit)
    )


def usage_overview(artifacts: DataFrame) -> DataFrame:
    """One row: datasets with calls, all calls, calls answered from cache."""
    per_dataset = artifacts.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("cached"), 1)).alias("cached")
    )
    return per_dataset.agg(
        F.count(F.lit(1)).alias("total_datasets"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("total_calls"),
        F.coalesce(F.sum("cached"), F.lit(0)).alias("cached_calls"),
    )


def latest_artifacts(artifacts: DataFrame, tie_break: Sequence[str] = ("request_id",)) -> DataFrame:
    """The newest artifact per dataset and function."""
    return _edge_step(artifacts, None, F.max_by, ["timestamp", *tie_break], ["dataset_id", "function_name"])


def _size(lists: Column) -> Column:
    return F.coalesce(F.size(lists), F.lit(0))


def _violations(answer: Column) -> dict[str, list[tuple[str, Column]]]:
    """Broken rules per function: required fields, list sizes, text lengths, ranges."""
    a = lambda name: answer[name]

    def missing(name: str) -> tuple[str, Column]:
        return f"{name}: missing", a(name).isNull()

    def length(name: str, low: int, high: int) -> tuple[str, Column]:
        return f"{name}: length {low}..{high}", ~F.char_length(a(name)).between(low, high)

    def size(name: str, low: int, high: int) -> tuple[str, Column]:
        return f"{name}: {low}..{high} entries", ~F.size(a(name)).between(low, high)

    def outside(name: str, low: int, high: int) -> tuple[str, Column]:
        return f"{name}: range {low}..{high}", ~a(name).between(low, high)

    suggested = a("suggested")
    return {
        "schema_description": [
            missing("column_descriptions"),
            missing("business_context"),
            missing("data_quality_notes"),
            missing("recommended_analyses"),
        ],
        "narrative_insights": [
            missing("executive_summary"),
            length("executive_summary", 10, 500),
            missing("key_findings"),
            size("key_findings", 1, 10),
            missing("risk_indicators"),
            size("risk_indicators", 0, 5),
            missing("opportunities"),
            size("opportunities", 0, 5),
            missing("recommendations"),
            size("recommendations", 1, 5),
        ],
        "risk_flags": [
            missing("level"),
            ("level: low, medium or high", ~a("level").isin("low", "medium", "high")),
            missing("reasons"),
            size("reasons", 1, 5),
            outside("score", 0, 100),
        ],
        "data_quality_report": [
            missing("issues"),
            size("issues", 0, 10),
            missing("recommendations"),
            size("recommendations", 0, 10),
            outside("severity_score", 1, 10),
        ],
        "threshold_recommendations": [
            missing("suggested"),
            size("suggested", 1, 5),
            ("suggested: range 1..100", F.exists(suggested, lambda x: ~x.between(1, 100))),
            ("suggested: unique", _size(F.array_distinct(suggested)) != _size(suggested)),
            missing("rationale"),
            length("rationale", 10, 300),
        ],
        "qa_over_context": [missing("answer"), length("answer", 1, 500), missing("citations"), size("citations", 0, 5)],
    }


ANSWER_SCHEMA = (
    "column_descriptions map<string,string>, business_context string, data_quality_notes array<string>, "
    "recommended_analyses array<string>, executive_summary string, key_findings array<string>, "
    "risk_indicators array<string>, opportunities array<string>, recommendations array<string>, level string, "
    "reasons array<string>, score double, issues array<string>, severity_score int, suggested array<int>, "
    "rationale string, answer string, citations array<string>"
)


def artifact_violations(artifacts: DataFrame, keep: Sequence[str] = ("dataset_id", "function_name")) -> DataFrame:
    """One row per artifact and broken rule."""
    parsed = artifacts.select(*keep, F.from_json("response", ANSWER_SCHEMA).alias("answer"))
    rules = _violations(F.col("answer"))
    checks = []
    for function, broken in rules.items():
        here = F.col("function_name") == function
        checks += [F.when(here & F.coalesce(cond, F.lit(False)), F.lit(text)) for text, cond in broken]
    unknown = F.when(~F.col("function_name").isin(list(rules)), F.lit("function_name: unknown"))
    return parsed.select(*keep, F.explode(F.array_compact(F.array(*checks, unknown))).alias("violation"))


def validate_schemas(documents: DataFrame, payload: str, row_counts: DataFrame | None = None) -> DataFrame:
    """dataset_id, severity, message for every problem in stored schema JSON; none means valid.

    ``row_counts`` (dataset_id, n_rows) says how many rows each dataset's
    normalized table has; an absent or empty one is an error.
    """
    root = F.from_json(F.col(payload), "map<string,string>")
    columns = F.from_json(root["columns"], "array<map<string,string>>")
    warnings = F.from_json(root["warnings"], "array<string>")
    opened = documents.select("dataset_id", root.alias("root"), columns.alias("columns"), warnings.alias("warnings"))

    def issue(severity: str, message: Column) -> Column:
        return F.struct(F.lit(severity).alias("severity"), message.alias("message"))

    # Records stored by dataset have their id in the folder name, that is in the frame.
    absent = F.filter(
        F.array(*[F.lit(k) for k in fixed.REQUIRED_SCHEMA_KEYS]),
        lambda k: ~F.map_contains_key(F.col("root"), k) & ((k != "dataset_id") | F.col("dataset_id").isNull()),
    )
    top = F.when(
        F.size(absent) > 0,
        F.array(issue("error", F.concat(F.lit(fixed.MISSING_KEYS), F.array_join(absent, ", ")))),
    ).otherwise(F.array().cast("array<struct<severity:string,message:string>>"))

    def column_issue(column: Column, i: Column) -> Column:
        gaps = F.filter(F.array(*[F.lit(k) for k in fixed.REQUIRED_COLUMN_KEYS]), lambda k: ~F.map_contains_key(column, k))
        name = F.coalesce(column["name"], F.lit("unknown"))
        text = F.format_string(fixed.COLUMN_MISSING_KEYS, i, name, F.array_join(gaps, ", "))
        return F.when(F.size(gaps) > 0, issue("warning", text))

    none = F.array().cast("array<struct<severity:string,message:string>>")
    per_column = F.coalesce(F.array_compact(F.transform("columns", column_issue)), none)
    copied = F.coalesce(
        F.transform("warnings", lambda w: issue("warning", F.concat(F.lit(fixed.QUALITY_WARNING), w))), none
    )
    found = opened.select("dataset_id", F.inline(F.concat(top, per_column, copied)))
    if row_counts is None:
        return found
    rows = documents.select("dataset_id").join(row_counts, "dataset_id", "left")
    n = F.coalesce(F.col("n_rows"), F.lit(0))
    data = rows.where(n == 0).select(
        "dataset_id", F.lit("error").alias("severity"), F.lit(fixed.NO_DATA).alias("message")
    )
    return found.unionByName(data)


def schema_verdicts(documents: DataFrame, payload: str, row_counts: DataFrame | None = None) -> DataFrame:
    """dataset_id, is_valid (no error), n_errors, n_warnings of every dataset."""
    found = validate_schemas(documents, payload, row_counts)
    counts = found.groupBy("dataset_id").agg(
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
    )
    all_ = documents.select("dataset_id").distinct().join(counts, "dataset_id", "left").fillna(0, ["n_errors", "n_warnings"])
    return all_.select("dataset_id", (F.col("n_errors") == 0).alias("is_valid"), "n_errors", "n_warnings")
