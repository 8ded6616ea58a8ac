"""The rank queue against the reference encoder."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from topshare.llm import rank_queue
from topshare.llm.queries import op7_rank_queue_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text):
    return np.frombuffer(rank_queue.encoder(PATH).encode_batch([text])[0], "<u4").tolist()


def test_random_texts(reference):
    rng = random.Random(3)
    for _ in range(800):
        text = "".join(rng.choice("aabbbcdeéñ  \n\tß1234!.'s🙂") for _ in range(rng.randrange(60)))
        assert ids(text) == reference.encode_ordinary(text), repr(text)


def test_characters(reference):
    for c in [*range(0x3100), 0xFEFF, 0x1F642, 0x10FFFF]:
        text = f"a{chr(c)} {chr(c)}b 1{chr(c)}!{chr(c)}{chr(c)} \n{chr(c)}"
        assert ids(text) == reference.encode_ordinary(text), hex(c)


def test_all_code_points(reference):
    # Letters, digits and an ending around each, so that another class of the character gives other ids.
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    bpe = rank_queue.encoder(PATH)
    for start in range(0, len(points), 1 << 14):
        text = "".join(f"x{chr(c)}'s{chr(c)}1{chr(c)}." for c in points[start : start + (1 << 14)])
        assert np.frombuffer(bpe.encode_batch([text])[0], "<u4").tolist() == reference.encode_ordinary(text), hex(points[start])


def test_characters_unknown_to_the_reference(reference):
    for c in (0x0558, 0x088F, 0x0C5C, 0x16EA0, 0x323B0):
        for text in (f"{chr(c)}'s", f"a{chr(c)}b", f"1{chr(c)}2 {chr(c)} {chr(c)}a", f"{chr(c)}{chr(c)}'ll!"):
            assert ids(text) == reference.encode_ordinary(text), (hex(c), text)


def test_classes_that_differ_either_way():
    unassigned = regex.compile(rank_queue.dated_pattern(r"\p{Cn}"), regex.V1)
    assert regex.search(r"\p{Cn}", chr(0x0558)) is None and unassigned.search(chr(0x0558))
    assert rank_queue._ranges({"a", "b", "c", "x"}) == r"\U00000061-\U00000063\U00000078-\U00000078"
    assert rank_queue.dated_pattern(r"\s+|[a-z]") == r"\s+|[a-z]"


@pytest.mark.parametrize("letters", ["a", "ab", "theinga", "abcdefghijklmnopqrstuvwxyz", "é漢"])
def test_long_pre_tokens(reference, letters):
    rng = random.Random(4)
    text = "".join(rng.choice(letters) for _ in range(20_000))
    assert ids(text) == reference.encode_ordinary(text)


def test_lower_rank_that_appears_later_goes_first():
    # Merging "bc" makes "abc" possible, whose rank is lower than that of the other "bc".
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"abcb": 258}
    bpe = rank_queue.RankQueueBPE(ranks, r"\S+")
    reference = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abcbc", "bcabcbc", "aabcbcbc", "abcabcab"):
        assert np.frombuffer(bpe.encode_batch([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_memory_forgets_without_changing_results(reference):
    bpe = rank_queue.RankQueueBPE(reference._mergeable_ranks, public_tokenizers.PATTERN)
    bpe.memory._remembered = 5
    for _ in range(3):
        for text in ("some words here, and some more", "and here\nother words", "x\n\ny z"):
            assert np.frombuffer(bpe.encode_batch([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_whole_table(spark, reference):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op7_rank_queue_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_cases(spark, reference):
    rows = [(1, None, 0), (2, "", 0), (None, "no id", 0), (3, "twice", 0), (3, "twice", 0), (4, "long " * 20_000, 0)]
    coded = rank_queue.encode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH)
    found = coded.withColumn("back", rank_queue.decode(F.col("ids"), PATH)).collect()
    assert sorted(bytes(r["back"]).decode() for r in found) == sorted(t or "" for _, t, _ in rows)
    assert all(r["ids"] == [] for r in found if r["doc_id"] in (1, 2))
    assert rank_queue.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


class Counted(dict):
    """Ranks that count how often one is looked up."""

    looked_up = 0

    def get(self, *args):
        self.looked_up += 1
        return super().get(*args)


def test_words_are_merged_by_the_bucket(reference):
    # One by one, every merge looks up the ranks of two pairs, so the two look-ups of a word would be some ten.
    rng = random.Random(5)
    words = [" " + "".join(rng.choices(["th", "er", "on", "ing", "a", "ou", "st"], k=6)) for _ in range(5_000)]
    bpe = rank_queue.RankQueueBPE(Counted(reference._mergeable_ranks), public_tokenizers.PATTERN)
    bpe.merge([w.encode() for w in words[:100]])  # makes its tables
    bpe._ranks.looked_up = 0
    merged = bpe.merge([w.encode() for w in words])
    assert bpe._ranks.looked_up < len(words)
    assert [np.frombuffer(m, "<u4").tolist() for m in merged] == [reference.encode_ordinary(w) for w in words]


@pytest.mark.parametrize("many", [1, 3, 24])
def test_full_buckets_of_any_ranks(monkeypatch, many):
    # Ranks in any order: a merge may make pairs that go before others of its bucket; runs of equal parts overlap.
    monkeypatch.setattr(rank_queue, "MANY", many)
    rng = random.Random(6)
    for _ in range(15):
        tokens = sorted({"".join(rng.choices("abc", k=rng.randrange(2, 7))) for _ in range(60)} | {"aa", "aaa"})
        rng.shuffle(tokens)
        ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + i for i, t in enumerate(tokens)}
        bpe = rank_queue.RankQueueBPE(ranks, public_tokenizers.PATTERN)
        known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        words = ["".join(rng.choices("abc", [5, 2, 1], k=rng.randrange(1, 30))) for _ in range(300)]
        words += ["a" * n for n in range(1, 40)] + ["ab" * 300, "".join(rng.choices("abc", k=2_000))]
        for texts in (words, [" ".join(words)]):
            for text, found in zip(texts, bpe.encode_batch(texts)):
                assert np.frombuffer(found, "<u4").tolist() == known.encode_ordinary(text), text


def test_gathered_batches(monkeypatch):
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": ["x" * 100 * i]}) for i in range(8)]
    monkeypatch.setattr(rank_queue, "GATHERED", 700)
    groups = list(rank_queue._gathered(iter(batches)))
    assert [b for g in groups for b in g] == batches and 2 < len(groups) < 8
    assert all(len(g) == 1 or sum(b.nbytes for b in g) <= 700 for g in groups)
    assert list(rank_queue._gathered(iter([]))) == []


def test_ids_that_do_not_exist(reference):
    bpe = rank_queue.encoder(PATH)
    assert bpe.decode([]) == b"" and bpe.decode([0, 0]) == reference.decode_bytes([0, 0])
    for wrong in (-1, 1 << 30):
        with pytest.raises(LookupError):
            bpe.decode([0, wrong])


@pytest.mark.parametrize("shared", [1, 9, 100])
def test_shares(monkeypatch, reference, shared):
    monkeypatch.setattr(rank_queue, "SHARED", shared)
    words = [" thingsther", "onersting", " a", "x" * 50, " erouth", "z", " thstou"]
    found = rank_queue.encoder(PATH).merge([w.encode() for w in words])
    assert [np.frombuffer(m, "<u4").tolist() for m in found] == [reference.encode_ordinary(w) for w in words]
    assert rank_queue.encoder(PATH).merge([]) == []
