"""CSV records over line breaks and splits, against Spark's reader of whole files."""

import random

import pytest

from topshare.sources import csv_records, files
from topshare.sources.csv_records import read_csv_records


@pytest.fixture
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "40"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def quoted(value: str) -> str:
    return '"' + value.replace('"', '""') + '"'


def random_file(seed: int, records: int) -> str:
    rng = random.Random(seed)
    bits = ["a", ",", '"', "\n", "\n\n", " ", "é", "漢", "long " * 40, "\n" * 30, '""', "x\ny"]
    lines = ["id,text,more"]
    for i in range(records):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        more = rng.choice(["", "plain", '""', quoted("b\nc"), "w" * rng.randrange(900)])
        lines.append(f"{i},{quoted(text)},{more}")
    return "\n".join(lines) + rng.choice(["", "\n", "\n\n"])


def sorted_rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_as_the_whole_file_reader(spark, tmp_path, tiny_splits, seed):
    for n in range(3):
        (tmp_path / f"{n}.csv").write_text(random_file(10 * seed + n, 60), newline="")
    found = read_csv_records(spark, str(tmp_path))
    want = files.read_csv(spark, str(tmp_path), multiLine=True)
    assert found.columns == want.columns == ["id", "text", "more"]
    assert sorted_rows(found) == sorted_rows(want) and found.count() == 180
    lines = csv_records._lines(spark, str(tmp_path))
    assert lines.select("path", "split").distinct().count() > 10 and lines.rdd.getNumPartitions() > 3


def test_a_record_over_many_splits(spark, tmp_path, tiny_splits):
    body = "line of text\n" * 500
    (tmp_path / "f.csv").write_text(f"a,b\n1,x\n2,{quoted(body)}\n3,{quoted(body)}\n4,y", newline="")
    assert sorted_rows(read_csv_records(spark, str(tmp_path))) == [("1", "x"), ("2", body), ("3", body), ("4", "y")]


def test_states_that_are_not_sent(spark, tmp_path, tiny_splits, monkeypatch):
    (tmp_path / "f.csv").write_text(random_file(77, 80), newline="")
    want = sorted_rows(read_csv_records(spark, str(tmp_path)))
    monkeypatch.setattr(csv_records, "_SENT_SPLITS", 0)
    assert sorted_rows(read_csv_records(spark, str(tmp_path))) == want and len(want) == 80


def test_carriage_returns_blank_lines_and_bom(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes('﻿a,"b\nc",a\r\n\r\n1,"x\r\ny",\r\n  \r\n2,"",z\r\n'.encode())
    found = read_csv_records(spark, str(tmp_path))
    assert found.columns == ["a0", "b\nc", "a2"]
    assert sorted_rows(found) == [("1", "x\r\ny", None), ("2", None, "z")]


def test_ragged_records(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n1,x,EXTRA\n2\n3,z\n")
    with pytest.raises(Exception):
        read_csv_records(spark, str(tmp_path)).collect()
    with pytest.raises(Exception):
        read_csv_records(spark, str(tmp_path)).select("a").collect()
    found = read_csv_records(spark, str(tmp_path), mode="PERMISSIVE")
    assert sorted_rows(found) == [("1", "x"), ("2", None), ("3", "z")]


def test_an_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b\n1,"x\n2,y\n3,z\n')
    with pytest.raises(Exception):
        read_csv_records(spark, str(tmp_path)).collect()


def test_headers_only_and_options(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a;b\n")
    assert read_csv_records(spark, str(tmp_path), sep=";").columns == ["a", "b"]
    assert read_csv_records(spark, str(tmp_path), sep=";").collect() == []
    with pytest.raises(ValueError):
        read_csv_records(spark, str(tmp_path), escape="\\")
