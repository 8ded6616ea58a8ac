"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of
one role share a block.  A block is ``<|turn|>role<|text|>text<|end|>``, further
texts of the block follow after ``<|next|>``.  Control strings inside roles and
texts, those of other templates included, get a backslash behind their first
character, and one more where there are some already; so taking one away gives
the text back, and no text can hold a control string of the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: What follows the first character of a control string: of this template, and of common others.
_REST = r"(\|[A-Za-z_]{1,32}\||/?s>|/?INST\]|/?SYS>>)"
CONTROL = rf"([<\[])(\\*){_REST}"
_ESCAPED = rf"([<\[])\\(\\*){_REST}"

#: Turns whose spans are gathered at once, and code points of a chunk in which spans are looked up.
_BLOCK = 512
_CHUNK = 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_conversations(turns: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans`` of every conversation in rows ``conv_id, turn, role, text``.

    ``loss_spans`` are start (from 0) and length, in code points of
    ``formatted``, of the texts of ``learned_role``, in order and without any
    mark.  Rows are in order of turn, nulls first; equal turns are in order of
    role and text, and repeated rows all stay.  A null role or text is an empty
    one; rows without conv_id are one conversation.  Other columns are not
    looked at.  A conversation is one row of the result, so its turns meet in
    one task; nothing wider than a conversation does.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    collected = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def piece(turn: Column, i: Column) -> Column:
        before = F.get("turns", i - 1)["role"]
        opened = F.concat(F.lit(TURN), escape(turn["role"]), F.lit(TEXT))
        mark = (
            F.when(i == 0, opened)
            .when(before == turn["role"], F.lit(NEXT))
            .otherwise(F.concat(F.lit(END), opened))
        )
        learned = turn["role"] == learned_role
        return F.struct(mark.alias("mark"), escape(turn["text"]).alias("body"), learned.alias("learned"))

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.char_length(p["mark"])
        length = F.char_length(p["body"])
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        spans = F.when(p["learned"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((start + length).alias("at"), spans.alias("spans"))

    none = F.array().cast("array<struct<start:int,length:int>>")
    pieces = collected.select("conv_id", F.transform("turns", piece).alias("pieces"))
    # Spans are gathered in blocks: a fold copies its list at every step, so a list over all turns would take quadratic time.
    block = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / _BLOCK).cast("int")),
        lambda b: F.slice("pieces", b * _BLOCK + 1, F.lit(_BLOCK)),
    )
    blocks = pieces.select("conv_id", "pieces", block.alias("blocks"))
    lengths = F.transform(
        "blocks",
        lambda b: F.aggregate(b, F.lit(0), lambda n, p: n + F.char_length(p["mark"]) + F.char_length(p["body"])),
    )
    starts = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    started = blocks.select("conv_id", "pieces", "blocks", starts.alias("starts"))
    spans = F.transform(
        "blocks",
        lambda b, i: F.aggregate(b, F.struct(F.get("starts", i).alias("at"), none.alias("spans")), step)["spans"],
    )
    return started.select(
        "conv_id",
        F.concat(
            F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["body"])), ""), F.lit(END)
        ).alias("formatted"),
        F.flatten(spans).alias("loss_spans"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of structs ``role, text``."""
    blocks = F.filter(F.split(formatted, rf"\Q{END}\E"), lambda b: b != "")

    def block(b: Column) -> Column:
        parts = F.split(F.substr(b, F.lit(len(TURN) + 1)), rf"\Q{TEXT}\E")
        role = unescape(parts[0])
        texts = F.split(parts[1], rf"\Q{NEXT}\E")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, block))


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, without escapes.

    The text is cut once into chunks of equal length, so each span is found by
    its place; a substring of the whole would count code points from the start.
    """
    chunks = F.regexp_extract_all(formatted, F.lit(rf"(?s).{{1,{_CHUNK}}}"), F.lit(0))

    def chunk_of(place: Column) -> Column:
        return F.floor(place / _CHUNK).cast("int")

    def text(chunk: Column, span: Column) -> Column:
        first, last = chunk_of(span["start"]), chunk_of(span["start"] + F.greatest(span["length"], F.lit(1)) - 1)
        around = F.array_join(F.slice(chunk, first + 1, last - first + 1), "")
        return unescape(F.substr(around, span["start"] % _CHUNK + 1, span["length"]))

    # One element holds the chunks, so that they are cut once.
    found = F.transform(F.array(chunks), lambda c: F.array_join(F.transform(spans, lambda s: text(c, s)), ""))
    return found[0]
