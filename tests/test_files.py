import hashlib
from pathlib import Path

import pytest

from topshare.session import materialize, release, scratch_root
from topshare.sources import files
from topshare.sources.fixtures import write_samples


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(1, 'a "quoted", text', 1.5, None), (2, "é line", None, True)], "id int, t string, x double, b boolean")


def test_csv(spark, table, tmp_path, rows):
    path = str(tmp_path / "csv")
    files.write_csv(table, path, single_file=True)
    back = files.read_csv(spark, path)
    assert set(dict(back.dtypes).values()) == {"string"}
    assert rows(back) == [("1", 'a "quoted", text', "1.5", None), ("2", "é line", None, "true")]
    assert len(list(Path(path).glob("part-*"))) == 1


def test_parquet_and_checksums(spark, table, tmp_path, rows):
    path = str(tmp_path / "parquet")
    manifest = files.write_parquet(table.coalesce(1), path).collect()
    (part,) = Path(path).glob("part-*")
    assert [(r["length"], r["sha256"]) for r in manifest] == [(part.stat().st_size, hashlib.sha256(part.read_bytes()).hexdigest())]
    assert rows(files.read_parquet(spark, path)) == rows(table)
    narrow = files.read_parquet(spark, path, ["x"])
    assert "ReadSchema: struct<x:double>" in narrow._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception):
        files.write_parquet(table, path)


def test_json(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n  "steps": [{"id": "st_0001"}],\n  "dataset_id": "d"\n}')
    found = files.read_json(spark, str(tmp_path / "one.json"), "dataset_id string, steps array<struct<id:string>>", multi_line=True)
    assert found.first()["steps"][0]["id"] == "st_0001"


def test_scratch(spark, table, rows):
    stored, path = materialize(table, "test")
    assert path.startswith(scratch_root(spark))
    assert rows(stored) == rows(table)
    release(spark, path)
    with pytest.raises(Exception):
        stored.collect()


def test_samples(spark, tmp_path):
    data = [(i, f"g{i % 4}", float(i), 2020 + i % 2) for i in range(200)]
    df = spark.createDataFrame(data, "id int, grp string, value double, year int")
    manifest = write_samples(df, str(tmp_path / "samples"), ["id"], "grp", "value", "year")
    counts = {r["name"]: r["n_rows"] for r in manifest.collect()}
    assert counts == {
        "sample_20pct": 40, "sample_small": 10, "sample_time_balanced": 20, "sample_top_entities": 200, "sample_edge_cases": 4,
        "sample_stratified": 32, "sample_with_nulls": 20, "sample_single_null_column": 16,
    }
    stored = spark.read.parquet(str(tmp_path / "samples" / "sample_single_null_column"))
    assert stored.where("value is null").count() == 4
    for r in manifest.collect():
        written = spark.read.parquet(str(tmp_path / "samples" / r["name"]))
        assert r["checksum"] == files.table_checksum(written.repartition(3)).first()["checksum"] and r["n_files"] > 0
    assert len({r["checksum"] for r in manifest.collect()}) == manifest.count()


def test_csv_reader_loses_nothing(spark, tmp_path, rows):
    ragged = tmp_path / "ragged.csv"
    ragged.write_text("a,b\n1,x,EXTRA\n2,y\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(ragged)).collect()
    with pytest.raises(Exception):
        files.read_csv(spark, str(ragged)).select("a").collect()
    assert rows(files.read_csv(spark, str(ragged), mode="PERMISSIVE")) == [("1", "x"), ("2", "y")]
    broken = tmp_path / "broken.csv"
    broken.write_text('a,b\n1,"x\ny, z"\n2,w\n')
    with pytest.raises(Exception):
        files.read_csv(spark, str(broken)).collect()
    assert rows(files.read_csv(spark, str(broken), multiLine=True)) == [("1", "x\ny, z"), ("2", "w")]


def test_columns_chosen_for_samples(spark, tmp_path):
    from topshare.sources.fixtures import chosen_columns

    rows = [(i, f"n{i}", f"g{i % 5}", float(i), 2020 + i % 3, None) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, name string, grp string, amount double, year int, gap string")
    assert chosen_columns(df, ["id"]) == {"group": "grp", "value": "amount", "period": "year"}
    assert chosen_columns(df)["value"] == "id"
    assert chosen_columns(df.select("id"), ["id"]) == {"group": None, "value": None, "period": None}
    given = write_samples(df, str(tmp_path / "given"), ["id"], "grp", "amount", "year").collect()
    chosen = write_samples(df, str(tmp_path / "chosen"), ["id"], choose=True).collect()
    told = lambda manifest: {(r["name"], r["n_rows"], r["checksum"]) for r in manifest}
    assert told(given) == told(chosen) and len(told(given)) == 8
