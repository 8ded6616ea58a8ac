"""Fill-in-the-middle training texts, cut by one counted regular expression for each text.

A unit is a run of characters other than white space with the white space
before it, or white space at the end.  ``regexp_count`` gives the number of
units ``n``; two numbers ``a <= b`` between 0 and ``n`` are drawn from a digest
of the id, and the pattern ``(unit{a}+)(unit{b-a}+)(.*+)`` of the row captures
prefix, middle and suffix in one match.  Groups and quantifiers are possessive:
the engine then repeats a unit in a loop and never goes back, so time is linear
and the stack stays flat for texts of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = "<[PSM]>"
_SPACE, _OTHER = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
UNIT = f"(?:{_SPACE}*+{_OTHER}++|{_SPACE}++)"


def _draw(digest: Column, place: int) -> Column:
    """The ``place``-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * place - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    seed: int = 42,
    percent: int = 50,
    spm_percent: int = 80,
) -> DataFrame:
    """One row for each document: ``doc_id, n, form, prefix, middle, suffix, output``; lazy, nothing is shuffled.

    ``form`` is ``psm`` (prefix, suffix, middle) or ``spm`` (suffix first) for
    ``percent`` of the documents, of which ``spm_percent`` are ``spm``, else
    ``plain``: the text as it is, with null prefix, middle and suffix.  The same
    id and seed always give the same draws, whatever the other rows are.

    A null text is an empty one.  Empty texts and those that contain a marker
    stay plain, so an output can always be read back (:func:`restore`).  A null
    id draws as an empty one.  Repeated rows give repeated results, an empty
    table none, and other columns are not looked at, whatever their names.
    """
    # Steps whose columns are used several times; the optimizer keeps such steps apart.
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = rows.select("*", F.regexp_count("text", F.lit(UNIT)).cast("bigint").alias("n"), digest.alias("digest"))
    first, second = (F.pmod(_draw(F.col("digest"), i), F.col("n") + 1) for i in (1, 2))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = (
        F.when((F.col("text") == "") | marked | (F.pmod(_draw(F.col("digest"), 3), F.lit(100)) >= percent), "plain")
        .when(F.pmod(_draw(F.col("digest"), 4), F.lit(100)) < spm_percent, "spm")
        .otherwise("psm")
    )
    formed = drawn.select(
        "doc_id", "text", "n", form.alias("form"), F.least(first, second).alias("a"), F.greatest(first, second).alias("b")
    )
    pattern = F.concat(
        F.lit(rf"(?s)\A({UNIT}{{"),
        F.col("a").cast("string"),
        F.lit(rf"}}+)({UNIT}{{"),
        (F.col("b") - F.col("a")).cast("string"),
        F.lit(r"}+)(.*+)\z"),
    )
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    done = formed.select("doc_id", "n", "form", output.alias("output"))
    cut = done.select("*", parts(F.col("output"), F.col("form")).alias("cut"))
    return cut.select(
        "doc_id", "n", "form", *[F.col(f"cut.{c}").alias(c) for c in ("prefix", "middle", "suffix")], "output"
    )


def parts(output: Column, form: Column) -> Column:
    """A struct ``prefix, middle, suffix`` of an output; null for ``plain``.

    No part contains a marker, so an output falls into three parts at its markers.
    """
    # One element holds the split text, so that it is split once.
    found = F.transform(
        F.array(F.split(output, _MARK, -1)),
        lambda p: F.struct(
            F.when(form == "psm", p[1]).otherwise(p[2]).alias("prefix"),
            p[3].alias("middle"),
            F.when(form == "psm", p[2]).otherwise(p[1]).alias("suffix"),
        ),
    )
    return F.when(form != "plain", found[0])


def restore(output: Column, form: Column) -> Column:
    """The text behind an output."""
    found = F.transform(F.array(parts(output, form)), lambda p: F.concat(p["prefix"], p["middle"], p["suffix"]))
    return F.when(form == "plain", output).otherwise(found[0])
