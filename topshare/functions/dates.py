"""Dates written as text, and period keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from topshare.functions import fixed
from topshare.functions.text_numbers import plain_number, stripped

UNKNOWN = "UNKNOWN"
ALL = "ALL"
MONTH_WORD = r"(?i)\b(" + "|".join(fixed.MONTH_WORDS) + r")\b"


def parse_timestamp(text: Column) -> Column:
    """TIMESTAMP of ISO text or one of the fixed layouts, else null.

    The shape decides the one layout to try: a failed attempt costs an exception.
    """
    clean = stripped(text)
    parsed = F.when(clean.rlike(f"^{fixed.ISO_SHAPE}$"), clean.try_cast("timestamp"))
    for layout, shape in fixed.DATE_LAYOUTS.items():
        found = F.try_to_timestamp(clean, F.lit(layout + fixed.TIME_LAYOUT))
        if layout.endswith("/yy"):
            # Two digits are read as 2000..2099; from the pivot on the last century is meant.
            early = F.regexp_extract(clean, r"^\d+/\d+/(\d{2})", 1).try_cast("int") >= fixed.TWO_DIGIT_YEAR_PIVOT
            found = found - F.when(early, F.expr("INTERVAL 100 YEARS")).otherwise(F.expr("INTERVAL 0 YEARS"))
        parsed = parsed.when(clean.rlike(f"^{shape}{fixed.TIME_SHAPE}$"), found)
    return parsed


def whole_part(column: Column, text: bool = True) -> Column:
    """Integer part of a number (``text`` says whether it is written as text), else null."""
    if text:
        return plain_number(column).try_cast("bigint")
    number = column.cast("double")
    return F.when(~F.isnan(number), number.try_cast("bigint"))


def month_number(month: Column, text: bool = True) -> Column:
    """1..12 from a number or an English month name or abbreviation, else null."""
    number = whole_part(month, text)
    in_range = F.when(number.between(1, 12), number)
    if not text:
        return in_range
    names = {**fixed.MONTHS, **{name[:3]: number for name, number in fixed.MONTHS.items()}}
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(in_range, F.element_at(lookup, F.lower(stripped(month))).cast("bigint"))


def quarter_number(quarter: Column, text: bool = True) -> Column:
    """1..4 from a number or Q1..Q4, else null."""
    number = whole_part(quarter, text)
    in_range = F.when(number.between(1, 4), number)
    if not text:
        return in_range
    return F.coalesce(in_range, F.regexp_extract(F.upper(stripped(quarter)), "^Q([1-4])$", 1).try_cast("bigint"))


def month_like(text: Column) -> Column:
    """A number from 1 to 12, or any text with an English month word in it."""
    return F.coalesce(whole_part(text).between(1, 12), F.lit(False)) | text.rlike(MONTH_WORD)


def date_key(when: Column) -> Column:
    """YYYY-MM-DD of a DATE or TIMESTAMP."""
    return F.coalesce(when.cast("date").cast("string"), F.lit(UNKNOWN))


def year_key(year: Column, text: bool = True) -> Column:
    return F.coalesce(whole_part(year, text).cast("string"), F.lit(UNKNOWN))


def year_month_key(year: Column, month: Column, year_text: bool = True, month_text: bool = True) -> Column:
    y = whole_part(year, year_text).cast("string")
    m = F.lpad(month_number(month, month_text).cast("string"), 2, "0")
    return F.coalesce(F.concat(y, F.lit("-M"), m), F.lit(UNKNOWN))


def year_quarter_key(year: Column, quarter: Column, year_text: bool = True, quarter_text: bool = True) -> Column:
    y = whole_part(year, year_text).cast("string")
    q = quarter_number(quarter, quarter_text).cast("string")
    return F.coalesce(F.concat(y, F.lit("-Q"), q), F.lit(UNKNOWN))
