"""Line frequency: figures against plain Python, counts against SQL (see test_llm_queries), cases."""

import random

from topshare.llm import line_frequency

SCHEMA = "doc_id long, text string, source string, kept string, removed int"


def plain_repeated(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside.update(range(i, i + 5))
    return len(inside)


def test_repeated_words():
    rng = random.Random(5)
    for size, letters in ((0, "a"), (4, "a"), (5, "a"), (30, "a"), (200, "ab"), (300, "abcde"), (400, "abcdefghij")):
        words = [rng.choice(letters).encode() for _ in range(size)]
        assert line_frequency.repeated_words(words) == plain_repeated(words)
    many = [str(i).encode() for i in range(8000)]  # so many words that windows are numbered in steps
    assert line_frequency.repeated_words(many + many[:7]) == 14


def test_normalised_lines():
    same = ["Read  12 more", "read 7 MORE ", "\tread 0 more"]
    assert len({line_frequency.line_hash(x) for x in same}) == 1
    assert line_frequency.line_hash("read more") != line_frequency.line_hash(same[0])


def shared(n, source, first):
    own = [" ".join(f"{chr(97 + i)}{chr(97 + k)}" for k in range(15)) for i in range(n)]  # no digits: those are alike
    return [(first + i, f"Shared line number {i} of this host.\n{own[i]}", source, "k", 0) for i in range(n)]


def test_limits_copies_and_cases(spark):
    rows = shared(15, "big", 0) + shared(8, "small", 100) + shared(12, None, 200)
    alone = "Only this line of ten words or more stands here alone"
    rows += [(300 + i, alone, "copies", "k", 0) for i in range(50)]  # copies are documents too
    stock = "A sentence with more than ten words that very many documents of a host hold in full"
    rows += [(400 + i, f"{stock}\nextra{i}", "stock", "k", 0) for i in range(20)]
    rows += [(500, None, "x", "k", 0), (501, "", "x", "k", 0), (502, "a b c d e f g h i", "x", "k", 0), (503, "w " * 50_000, "x", "k", 0)]
    rows += [(0, rows[0][1], "big", "k", 0)]
    verdicts = line_frequency.judge(spark.createDataFrame(rows, SCHEMA))
    found = {}
    for r in verdicts.collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    assert all(r["n_removed_words"] == 7 and r["kept"] for d in range(15) for r in found[d]) and len(found[0]) == 2
    assert all(found[100 + i][0]["n_removed_words"] == 0 for i in range(8))
    assert all(found[200 + i][0]["n_removed_words"] == 7 for i in range(12))
    assert not any(found[300 + i][0]["kept"] or found[300 + i][0]["base_failed"] for i in range(50))
    assert not any(found[400 + i][0]["kept"] or found[400 + i][0]["base_failed"] for i in range(20))
    assert all(found[d][0]["base_failed"] for d in (500, 501, 502, 503))
    docs = spark.createDataFrame(rows, SCHEMA)
    clean = line_frequency.cleaned(docs, verdicts)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[3] == rows[3][1].split("\n")[1] and texts[100] == rows[15][1]
    assert 300 not in texts and 400 not in texts and 500 not in texts


def test_hundreds_of_copies_are_rejected(spark):
    text = "The first line of a text that was copied.\nAnd its second line, with some more words."
    rows = [(i, text, "hot", "k", 0) for i in range(300)] + shared(5, "hot", 1000)
    found = {r["doc_id"]: r for r in line_frequency.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[i]["n_removed_words"] == found[i]["n_words"] and not found[i]["kept"] for i in range(300))
    assert all(found[1000 + i]["n_removed_words"] == 0 and found[1000 + i]["kept"] for i in range(5))


def test_the_same_verdicts_in_a_host_of_any_size(spark):
    """Twelve documents share a line; thirty thousand others of the host change nothing for them."""
    rows = shared(12, "hot", 0) + shared(9, "cold", 100)
    small = {r["doc_id"]: tuple(r) for r in line_frequency.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    others = spark.range(1000, 31_000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 12), k -> md5(cast(id * 100 + k AS string)))) AS text")
    others = others.selectExpr("doc_id", "translate(text, '0123456789', 'ghijklmnop') AS text", "'hot' AS source", "'k' AS kept", "0 AS removed")
    large = line_frequency.judge(spark.createDataFrame(rows, SCHEMA).unionByName(others))
    assert {r["doc_id"]: tuple(r) for r in large.where("doc_id < 1000").collect()} == small
    assert {r[0]: r[-2] for r in small.values()} == {**dict.fromkeys(range(12), 7), **dict.fromkeys(range(100, 109), 0)}


def test_rows_of_one_document_count_once(spark):
    text = "A line that one document has in many rows, each of them counted once.\n"
    rows = [(1, text + f"row {'x' * i}", "h", "k", 0) for i in range(40)] + [(None, text, "h", "k", 0)] * 20
    rows += [(10 + i, text, "h", "k", 0) for i in range(8)]  # ten documents in all
    judged = line_frequency.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(judged) == 68 and {r["n_removed_words"] for r in judged} == {0}
    rows.append((99, text, "h", "k", 0))
    judged = line_frequency.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["n_removed_words"] for r in judged} == {14}


def test_empty_table(spark):
    assert line_frequency.judge(spark.createDataFrame([], SCHEMA)).collect() == []
