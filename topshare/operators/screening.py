"""Redaction and screening of text columns, as projections over whole texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topshare.functions import fixed
from topshare.functions.naming import alias_for

# Unicode-aware classes and word borders, any case.
_FLAGS = "(?iU)"


def mark(kind: str) -> str:
    return f"[REDACTED_{kind.upper()}]"


def redact(text: Column) -> Column:
    """Replace e-mail addresses, phone, social security and card numbers by typed marks, in that order."""
    for kind, pattern in fixed.PII.items():
        text = F.regexp_replace(text, _FLAGS + pattern, mark(kind))
    return text


def with_pii_counts(df: DataFrame, text: str) -> DataFrame:
    """Add n_<kind> columns and ``redacted``.

    Each kind is counted on what the kinds before it left, so the counts are
    the numbers of marks set.
    """
    step = df.withColumn("redacted", F.col(f"`{text}`"))
    for kind, pattern in fixed.PII.items():
        expression = _FLAGS + pattern
        step = step.withColumn(
            f"n_{kind}", F.coalesce(F.regexp_count("redacted", F.lit(expression)), F.lit(0)).cast("bigint")
        ).withColumn("redacted", F.regexp_replace("redacted", expression, mark(kind)))
    return step


def pii_report(df: DataFrame, text: str, by: Sequence[str]) -> DataFrame:
    """Sums of matches per kind and group."""
    kinds = list(fixed.PII)
    return (
        with_pii_counts(df.select(*by, text), text)
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_texts"), *[F.sum(f"n_{k}").alias(f"n_{k}") for k in kinds])
    )


def sanitized_sample(df: DataFrame, order_by: Sequence[str], rows: int = fixed.SAMPLE_ROWS) -> DataFrame:
    """The first rows by key, every value as redacted text, identifier-like columns under an alias."""
    first = df.orderBy(*[F.col(f"`{c}`").asc() for c in order_by]).limit(rows)
    return first.select(*[redact(F.col(f"`{c}`").cast("string")).alias(alias_for(c)) for c in df.columns])


def shortened(text: Column, length: int) -> Column:
    return F.when(F.char_length(text) > length, F.concat(text.substr(1, length), F.lit("..."))).otherwise(text)


def without_control_characters(text: Column) -> Column:
    """Drop control characters except tab and line feed."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F]", "")


def clean_input(text: Column) -> Column:
    """User input as it may be shown: shortened, without control characters; null is empty."""
    return F.coalesce(without_control_characters(shortened(text, fixed.INPUT_LENGTH)), F.lit(""))


def screen_messages(df: DataFrame, text: str) -> DataFrame:
    """Add one flag per injection pattern, ``is_unsafe`` and the ``question`` as it may be shown.

    The flags are about the whole text, also beyond the length shown.
    """
    column = F.col(f"`{text}`")
    flags = {
        name: F.coalesce(column.rlike(_FLAGS + pattern), F.lit(False)) for name, pattern in fixed.INJECTION.items()
    }
    flagged = df.withColumns(flags)
    unsafe = F.array_contains(F.array(*[F.col(n) for n in flags]), True)
    question = F.coalesce(redact(shortened(column, fixed.QUESTION_LENGTH)), F.lit(""))
    return flagged.withColumn("is_unsafe", unsafe).withColumn("question", F.when(~F.col("is_unsafe"), question))


def row_fingerprint(columns: Sequence[str]) -> Column:
    """First 16 hex digits of SHA-256 over the row as JSON text with sorted keys.

    Values keep their types, so the number 1 and the text "1" differ.
    """
    ordered = F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(columns)])
    moment = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    options = {"ignoreNullFields": "false", "timestampFormat": moment, "timestampNTZFormat": moment}
    return F.substring(F.sha2(F.to_json(ordered, options), 256), 1, 16)
