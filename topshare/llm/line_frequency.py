"""Cross-document line frequency: lines that too many documents of a host share are taken out.

A line counts once for each distinct document (doc_id) of its host (the source)
that has it, however often the document repeats it.  A line found in more
documents of a host than the limit allows is removed from every document of the
host; a document that keeps too little is rejected.  The limit is a number of
documents, so what becomes of a group of documents doesn't depend on how many
others the host has.  Lines are compared without regard to case of letters, runs
of white space and the figures in numbers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topshare.llm.common import prepare_workers, texts_of, written

#: A line is over the limit in more documents of a host.
MAX_DOCUMENTS = 10
#: A document is depleted with fewer words, or a smaller share of its words, left.
LEAST_WORDS = 10
LEAST_SHARE = 0.3
#: Base rules.
WINDOW = 5
MAX_REPEATED_PERCENT = 20

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
_NUMBER = re.compile(rb"[0-9]+")


def line_hash(line: str) -> int:
    """A signed 64-bit hash of the normalised line."""
    plain = _NUMBER.sub(b"0", b" ".join(line.lower().encode().split()))
    return int(np.uint64(xxhash.xxh64_intdigest(plain)).astype(np.int64))


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of ``WINDOW`` words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    keys, size = ids[:n].copy(), len(known)
    for k in range(1, WINDOW):
        if size > (1 << 62) // (len(known) + 1):  # number the windows so far anew
            keys = np.unique(keys, return_inverse=True)[1]
            size = int(keys.max()) + 1
        keys = keys * len(known) + ids[k : n + k]
        size *= len(known)
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: str) -> tuple:
    """The base figures of a text, a digest of it, and hash and words of each of its lines that has a word."""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        hashlib.blake2b(text.encode(), digest_size=16).digest(),
        [(line_hash(line), len(line.encode().split())) for line in lines],
    )


_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_digest"]


def _measured(docs: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    """One narrow row for each document, written: the texts are read once."""
    prepare_workers(docs.sparkSession)
    kind, host = (docs.schema[c].dataType.simpleString() for c in (id_column, host_column))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [measure(t) for t in texts_of(batch["text"])]
            frame = pd.DataFrame([r[:6] for r in rows], columns=_NAMES)
            frame["hashes"] = [[h for h, _ in r[6]] for r in rows]
            frame["line_words"] = [[w for _, w in r[6]] for r in rows]
            yield pd.concat([batch[["doc_id", "host"]].reset_index(drop=True), frame], axis=1)

    schema = f"doc_id {kind}, host {host}, {_FIGURES}, text_digest binary, hashes array<long>, line_words array<long>"
    source = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(host_column).alias("host")
    )
    return written(source.mapInPandas(run, schema).withColumn("row", F.monotonically_increasing_id()), "lines")


def lines_over_limit(measured: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """``host, hash`` of the lines to remove.

    Rows are counted first, with partial sums before the shuffle; they are as
    many as the documents, or more where a doc_id repeats.  So only lines in more
    rows than the limit have their documents told apart.
    """
    found = measured.select("host", "doc_id", F.explode(F.array_distinct("hashes")).alias("hash"))
    rows = found.groupBy("host", "hash").count().where(F.col("count") > max_documents)
    frequent = written(rows.select("host", "hash"), "frequent-lines")
    same = F.expr("l.hash = f.hash AND l.host <=> f.host")
    documents = found.alias("l").join(frequent.alias("f"), same).select("l.host", "l.hash", "l.doc_id").distinct()
    over = documents.groupBy("host", "hash").count().where(F.col("count") > max_documents)
    return written(over.select("host", "hash"), "lines-over-limit")


def judge(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    max_documents: int = MAX_DOCUMENTS,
) -> DataFrame:
    """Base figures, lines to remove and verdict of every row (this starts jobs).

    ``doc_id``, the figures, ``base_failed``, ``text_digest``, ``removed`` (the
    hashes of lines to remove, or null), ``n_removed_words`` and ``kept``.
    A null text is an empty one, and fails the base rules; rows without a host
    form a host of their own, and rows without an id are one document of their
    host; repeated rows are one document and get equal verdicts.  Other columns
    are not looked at.
    """
    measured = _measured(docs, id_column, text_column, host_column)
    over = lines_over_limit(measured, max_documents)
    lines = measured.select("row", "host", F.explode(F.arrays_zip("hashes", "line_words")).alias("line"))
    lines = lines.select("row", "host", F.col("line.hashes").alias("hash"), F.col("line.line_words").alias("words"))
    # Both sides come from written tables, so a line that a third of all rows have can be split.
    hits = lines.alias("l").join(
        over.alias("o"), F.expr("l.hash = o.hash AND l.host <=> o.host")
    )
    removed = hits.groupBy("row").agg(
        F.collect_set("l.hash").alias("removed"), F.sum("words").alias("n_removed_words")
    )
    figures = measured.join(removed, "row", "left").withColumn(
        "n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long"))
    )
    left = F.col("n_words") - F.col("n_removed_words")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return figures.withColumn("base_failed", failed).select(
        "doc_id",
        *_NAMES[:5],
        "base_failed",
        "text_digest",
        "removed",
        "n_removed_words",
        (~F.col("base_failed") & (left >= LEAST_WORDS) & (left >= LEAST_SHARE * F.col("n_words"))).alias("kept"),
    )


def cleaned(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The kept rows of ``documents`` with the shared lines taken out of their texts; all columns stay."""
    prepare_workers(docs.sparkSession)

    @F.pandas_udf("string")
    def without(text: pd.Series, removed: pd.Series) -> pd.Series:
        cut = []
        for t, hashes in zip(texts_of(text), removed):
            gone = set() if hashes is None else set(hashes)
            cut.append("\n".join(x for x in t.split("\n") if not gone or not x.strip(SPACES) or line_hash(x) not in gone))
        return pd.Series(cut)

    @F.pandas_udf("binary")
    def digest(text: pd.Series) -> pd.Series:
        return pd.Series([hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts_of(text)])

    kept = verdicts.where("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_digest").alias("__digest"), F.col("removed").alias("__removed")
    ).dropDuplicates(["__id", "__digest"])
    found = docs.withColumn("__text_digest", digest("text")).join(
        kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_digest") == F.col("__digest"))
    )
    return found.withColumn("text", without("text", "__removed")).select(docs.columns)
