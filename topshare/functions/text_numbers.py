"""Numbers, percents and booleans written as text, as column expressions.

``parse_numbers`` works in a few ``select`` layers.  Each layer reads the one
before more than once; as one nested expression the plan would grow
exponentially, and Catalyst does not merge layers that would repeat work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topshare.functions import fixed

PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHOLE_NUMBER = r"^[+-]?\d+$"
# Every blank other than the plain space.
OTHER_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
MINUS = "\u2212"

_ANY_CODE = "|".join(fixed.CURRENCY_CODES)
_CODE = rf"(?U)\b({_ANY_CODE})\b"
_SCALE_END = r"[kKmMbBnN]$"
# A grouped, signed number if it is the whole text, else the last plain number.
_SCALED = r"(?i)(^[+-]?\s*\d[\d.,'\s]*?|\d+(?:[.,]\d+)?)\s*(mm|bn|k|m|b)$"


def stripped(text: Column) -> Column:
    """Text with plain spaces for all blanks and none around it."""
    return F.trim(F.translate(text, OTHER_BLANKS, " " * len(OTHER_BLANKS)))


def plain_number(text: Column, clean: bool = False) -> Column:
    """DOUBLE of a plain number, else null.  The pattern keeps engine-specific literals out.

    Here and below ``clean`` says that the text is stripped already.
    """
    text = text if clean else stripped(text)
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def parse_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each text column by a struct.

    text: the stripped text; number: the value or null; plain: needed no cleaning; coerced: parsed after
    cleaning; failed: non-blank text that is no number; currency: removals;
    parentheses, scaled, minus: what was found; convention: US or EU;
    symbols: currencies.

    The costly patterns are behind a simple one for a character they need.
    The steps are kept few and small: the JVM does not compile a generated
    method of more than 8,000 bytes, which costs more than any pattern.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in columns]

    def layer(frame: DataFrame, carried: list[str], made) -> DataFrame:
        fields = []
        for c in columns:
            at = lambda n, c=c: F.col(f"`{c}::{n}`")
            new = made(at)
            fields += [at(n) for n in carried if n not in new]
            fields += [expression.alias(f"{c}::{n}") for n, expression in new.items()]
        return frame.select(*others, *fields)

    step = df.select(*others, *[stripped(F.col(f"`{c}`")).alias(f"{c}::text") for c in columns])
    step = layer(step, ["text"], lambda at: {"plain": at("text").rlike(PLAIN_NUMBER)})
    # Plain numbers travel on as null, so that the steps below skip them.
    step = layer(
        step,
        ["text", "plain"],
        lambda at: {"rough": F.when(~at("plain") & ~F.lower(at("text")).isin("", "nan"), at("text"))},
    )
    step = layer(
        step,
        ["text", "plain", "rough"],
        lambda at: {"bare": F.translate(at("rough"), MINUS + fixed.CURRENCY_SYMBOLS, "-")},
    )
    step = layer(
        step,
        ["text", "plain", "rough", "bare"],
        lambda at: {
            "signed": F.length(at("bare")) < F.length(at("rough")),
            "code": F.when(
                at("bare").rlike(_ANY_CODE), F.nullif(F.regexp_extract(at("bare"), _CODE, 1), F.lit(""))
            ),
        },
    )
    kept = ["text", "plain", "rough", "signed", "code"]
    step = layer(
        step,
        kept,
        lambda at: {
            "bare": F.trim(F.when(at("code").isNotNull(), F.regexp_replace(at("bare"), _CODE, "")).otherwise(at("bare")))
        },
    )
    step = layer(
        step,
        kept,
        lambda at: {
            "parentheses": at("bare").startswith("(") & at("bare").endswith(")"),
            "bare": F.trim(F.regexp_replace(at("bare"), r"(?s)^\((.*)\)$", "-$1")),
        },
    )
    kept.append("parentheses")
    step = layer(
        step,
        kept,
        lambda at: {
            "bare": F.when(
                at("bare").endswith("-"),
                F.concat(F.lit("-"), F.trim(F.substring(at("bare"), F.lit(1), F.length(at("bare")) - 1))),
            ).otherwise(at("bare"))
        },
    )
    step = layer(
        step,
        [*kept, "bare"],
        lambda at: {
            "suffix": F.when(at("bare").rlike(_SCALE_END), F.lower(F.regexp_extract(at("bare"), _SCALED, 2)))
        },
    )
    kept.append("suffix")
    step = layer(
        step,
        kept,
        lambda at: {
            "bare": F.translate(
                F.when(at("suffix") != "", F.regexp_extract(at("bare"), _SCALED, 1)).otherwise(at("bare")), " '", ""
            )
        },
    )
    step = layer(
        step,
        [*kept, "bare"],
        lambda at: {
            # With both marks the last one is the decimal mark; a comma alone is one before one or two digits.
            "convention": F.when(
                at("bare").contains(","),
                F.when(at("bare").rlike(r"\..*,[^.]*$|^[^.]*,\d{1,2}$"), F.lit("EU")).otherwise(F.lit("US")),
            )
        },
    )
    kept.append("convention")
    step = layer(
        step,
        kept,
        lambda at: {
            "bare": F.when(at("convention") == "US", F.translate(at("bare"), ",", ""))
            .when(at("convention") == "EU", F.translate(at("bare"), ",.", "."))
            .otherwise(at("bare"))
        },
    )
    step = layer(
        step, kept, lambda at: {"parsed": F.when(at("bare").rlike(PLAIN_NUMBER), at("bare").try_cast("double"))}
    )

    def finished(c: str) -> Column:
        at = lambda n: F.col(f"`{c}::{n}`")
        yes = lambda condition: F.coalesce(condition, F.lit(False))
        factor = F
        for name, value in fixed.SCALES.items():
            factor = factor.when(at("suffix") == name, F.lit(value))
        symbols = F.array_distinct(F.regexp_extract_all(at("rough"), F.lit(f"([{fixed.CURRENCY_SYMBOLS}])"), 1))
        signs = F.when(at("signed"), symbols)
        return F.struct(
            at("text").alias("text"),
            F.when(at("plain"), at("text").try_cast("double"))
            .otherwise(at("parsed") * factor.otherwise(F.lit(1.0)))
            .alias("number"),
            yes(at("plain")).alias("plain"),
            at("parsed").isNotNull().alias("coerced"),
            (at("rough").isNotNull() & at("parsed").isNull()).alias("failed"),
            # A symbol and a code in one value are two removals.
            (yes(at("signed")).cast("int") + at("code").isNotNull().cast("int")).alias("currency"),
            yes(at("parentheses")).alias("parentheses"),
            yes(at("suffix") != "").alias("scaled"),
            yes(at("rough").contains(MINUS)).alias("minus"),
            at("convention").alias("convention"),
            signs.alias("symbols"),
            at("code").alias("code"),
        ).alias(c)

    return step.select(*others, *[finished(c) for c in columns]).select(*[F.col(f"`{c}`") for c in df.columns])


def percent_share(text: Column, name_says_percent: bool, clean: bool = False) -> Column:
    """STRUCT(number, changed): "12%" is 0.12; under a percent header 1 < x <= 100 is x / 100."""
    text = text if clean else stripped(text)
    without_sign = F.rtrim(F.substring(text, F.lit(1), F.length(text) - 1))
    marked = F.when(text.endswith("%"), plain_number(without_sign, clean=True))
    number = plain_number(text, clean=True)
    large = (number > 1) & (number <= 100) if name_says_percent else F.lit(False)
    return F.struct(
        F.when(marked.isNotNull(), marked / 100).when(large, number / 100).otherwise(number).alias("number"),
        F.coalesce(marked.isNotNull() | large, F.lit(False)).alias("changed"),
    )


def rescaled(number: Column) -> Column:
    """Numbers under a percent header: 1 < x <= 100 is x / 100, others stay."""
    return F.when((number > 1) & (number <= 100), number / 100).otherwise(number)


def as_boolean(text: Column, clean: bool = False) -> Column:
    """TRUE, FALSE or null for anything that is no boolean word."""
    word = F.lower(text if clean else stripped(text))
    return F.when(word.isin(fixed.TRUE_WORDS), True).when(word.isin(fixed.FALSE_WORDS), False)
