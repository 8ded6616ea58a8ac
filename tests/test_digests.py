"""Digests of files by pieces, by blocks and as a tree."""

import hashlib
import resource

import pytest

from topshare.sources import digests


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a b.bin").write_bytes(bytes(range(256)) * 40)
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "é%20.bin").write_bytes(b"x" * 1000)
    return tmp_path


def by_name(frame, *columns):
    return {r["path"].rsplit("/", 1)[1]: tuple(r[c] for c in columns) for r in frame.collect()}


def test_whole_files(spark, folder):
    want = {p.name: (p.stat().st_size, sha(p.read_bytes())) for p in folder.rglob("*.bin") if p.stat().st_size}
    assert by_name(digests.file_manifest(spark, str(folder)), "length", "sha256") == want
    assert by_name(digests.file_manifest(spark, str(folder), schemes=()), "length", "sha256") == want
    assert list(by_name(digests.file_manifest(spark, str(folder), "a*"), "length")) == ["a b.bin"]
    (folder / "none").mkdir()
    assert digests.file_manifest(spark, str(folder / "none")).collect() == []


def test_blocks_and_trees(spark, folder):
    blocks = digests.block_digests(spark, str(folder), block_bytes=1000)
    found = {}
    for r in sorted(blocks.collect(), key=lambda r: r["block"]):
        found.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["start"], r["length"], r["sha256"]))
    for p in folder.rglob("*.bin"):
        data = p.read_bytes()
        cuts = range(0, len(data), 1000)
        assert found.get(p.name, []) == [(c, len(data[c : c + 1000]), sha(data[c : c + 1000])) for c in cuts]
    tops = by_name(digests.roots(digests.digest_trees(blocks, 11, 3)), "root")
    for name, parts in found.items():
        level = [d for *_, d in parts]
        for _ in range(3):  # eleven blocks, three to a node
            level = [sha("".join(level[i : i + 3]).encode()) for i in range(0, len(level), 3)]
        assert tops[name] == (level[0],) and len(level) == 1


def test_changes_are_located(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"a" * 5000)
    before = digests.block_digests(spark, str(tmp_path), block_bytes=1000)
    before = spark.createDataFrame(before.collect(), before.schema)
    assert digests.changed_blocks(before, digests.block_digests(spark, str(tmp_path), block_bytes=1000)).collect() == []
    (tmp_path / "f").write_bytes(b"a" * 2500 + b"b" + b"a" * 3999)
    found = digests.changed_blocks(before, digests.block_digests(spark, str(tmp_path), block_bytes=1000)).collect()
    assert sorted((r["block"], r["change"]) for r in found) == [(2, "changed"), (5, "added"), (6, "added")]


def test_bad_sizes(spark, tmp_path):
    with pytest.raises(ValueError):
        digests.block_digests(spark, str(tmp_path), block_bytes=0)
    with pytest.raises(ValueError):
        digests.digest_trees(spark.createDataFrame([], "path string, block long, sha256 string"), 1, 1)


def test_shorter_than_listed(tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    with pytest.raises(OSError):
        digests.range_digest(str(tmp_path / "f"), 0, 4)


def test_a_file_above_two_gib_in_little_memory(spark, tmp_path):
    """Three GiB, sparse: more than one row of Spark can hold; this process' peak barely moves."""
    size, chunk = 3 << 30, bytes(1 << 20)
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    whole = hashlib.sha256()
    for _ in range(size >> 20):
        whole.update(chunk)
    assert digests.range_digest(str(tmp_path / "large"), 0, size) == whole.hexdigest()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB
    (row,) = digests.file_manifest(spark, str(tmp_path)).collect()
    assert (row["length"], row["sha256"]) == (size, whole.hexdigest())
    blocks = digests.block_digests(spark, str(tmp_path), block_bytes=1 << 30).collect()
    assert len(blocks) == 3 and len({r["sha256"] for r in blocks}) == 1
