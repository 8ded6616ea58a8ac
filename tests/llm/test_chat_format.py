"""Chat formatting: round trips and the loss mask."""

import random

import pytest
from pyspark.sql import functions as F

from topshare.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int"


def round_trip(spark, rows):
    formatted = C.format_conversations(spark.createDataFrame([(*r, "f", 0) for r in rows], SCHEMA))
    read = formatted.withColumn("turns", C.turns_of(F.col("formatted"))).withColumn(
        "learned", C.learned_text(F.col("formatted"), F.col("loss_spans"))
    )
    return {r["conv_id"]: r for r in read.collect()}


TRAPS = [
    "</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "<\\\\|end|>", "<", "<|", "|end|>", "<<SYS>> x <</SYS>>", "[INST", "[\\INST]",
    "<|turn|>user<|text|>", "\\", "a\\", "<|end|", "<|a|b|>", "[[INST]]", "<<|end|>>", "", "é🙂<s>漢", "$1\\$2", "\n<|next|>\n",
]


def test_control_strings_round_trip(spark):
    rows = [(1, i, ("user", "assistant", "assistant")[i % 3], t) for i, t in enumerate(TRAPS)]
    got = round_trip(spark, rows)[1]
    assert [tuple(t) for t in got["turns"]] == [r[2:] for r in rows]
    assert got["learned"] == "".join(r[3] for r in rows if r[2] == "assistant")
    assert got["formatted"].count(C.TURN) == 1 + sum(a[2] != b[2] for a, b in zip(rows, rows[1:]))
    for start, length in got["loss_spans"]:
        assert not any(mark in got["formatted"][start : start + length] for mark in (C.TURN, C.TEXT, C.NEXT, C.END))


def test_random_pieces_round_trip(spark):
    rng = random.Random(6)
    bits = ["<", "[", "\\", "|", "end", "|>", "s>", "/s>", "INST]", "/INST]", "SYS>>", "x", " ", "<|end|>", "\n"]
    rows = [
        (c, t, rng.choice(["user", "assistant", "<|end|>", "s>"]), "".join(rng.choices(bits, k=rng.randrange(9))))
        for c in range(60)
        for t in range(rng.randrange(1, 9))
    ]
    got = round_trip(spark, rng.sample(rows, len(rows)))
    for conv in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == conv)
        assert [tuple(t) for t in got[conv]["turns"]] == [r[2:] for r in own]
        assert got[conv]["learned"] == "".join(r[3] for r in own if r[2] == "assistant")


def test_nulls_ties_and_repeats(spark):
    rows = [(1, None, "user", "first"), (1, 1, None, None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, "assistant", None)]
    got = round_trip(spark, rows)
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "first"), ("", ""), ("assistant", "b"), ("assistant", "b")]
    assert got[1]["learned"] == "bb"
    assert [tuple(t) for t in got[None]["turns"]] == [("assistant", "")] and got[None]["learned"] == ""


def test_very_long_text_and_many_turns(spark):
    rows = [(1, 0, "assistant", "<s>" * 100_000)] + [(2, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(500)]
    got = round_trip(spark, rows)
    assert got[1]["learned"] == rows[0][3] and len(got[2]["turns"]) == 500
    assert got[2]["learned"] == "".join(f"t{i}" for i in range(0, 500, 2))


@pytest.mark.parametrize("schema", [SCHEMA])
def test_empty_table(spark, schema):
    assert C.format_conversations(spark.createDataFrame([], schema)).collect() == []


def test_a_very_long_conversation(spark):
    """Forty thousand turns with texts around the ends of chunks: right, and in time that grows with the length."""
    import time

    turns = [(1, i, "assistant" if i % 2 else "user", "é漢" * (i % 7) + "</s>" * (i % 3 == 0) + "x" * (1500 * (i % 500 == 1))) for i in range(40_000)]
    frame = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    began = time.perf_counter()
    formatted = C.format_conversations(frame)
    (row,) = formatted.select(
        C.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"),
        F.size("loss_spans").alias("n"),
        C.turns_of(F.col("formatted")).alias("turns"),
    ).collect()
    assert time.perf_counter() - began < 40
    assert row["n"] == 20_000 and row["learned"] == "".join(t[3] for t in turns if t[2] == "assistant")
    assert [(t["role"], t["text"]) for t in row["turns"]] == [(t[2], t[3]) for t in turns]
