"""SimHash near-duplicates: byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits agree in at least six
of their eight bytes: six is the guaranteed number of matches.  Lists of a
single byte and position hold 1/256 of all fingerprints and would pair nearly
everything, so the index is read at intersections of lists: the bytes form four
groups of two, and a pair with six matches agrees in two whole groups.  Each of
the six choices of two groups is a list of four positions (32 bits).  Inside a
list the shared bytes of every pair are tallied over all eight positions, pairs
with six or more are kept and then verified bit by bit.

Lists of more than ``PAIRED`` members are not paired: two members differ in at
most two bits exactly if both are one flip or none away from a common midpoint,
so members meet at midpoints of the 32 open bits, which is linear.  Lists of
more than ``LISTED`` members are listed anew by six positions; no such list can
hold more than 65,536 different fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from functools import partial
from itertools import chain, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topshare.llm.common import prepare_workers, texts_of, written
from topshare.llm.components import connected_components

BITS = 64
POSITIONS = 8
DISTANCE = 2
#: Bytes that fingerprints within ``DISTANCE`` bits share at least.
MATCHES = POSITIONS - DISTANCE
PAIRED = 256
LISTED = 65_536
_HASHED_AT_ONCE = 65_536


def _mask(positions: Iterable[int]) -> int:
    """The bits of some byte positions, as a signed long."""
    bits = sum(0xFF << (8 * p) for p in positions)
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


#: Positions of the lists: two of four groups of two bytes.
_GROUPS = [(p, p + 1) for p in range(0, POSITIONS, 2)]
_LISTS = [tuple(sorted(g + h)) for g, h in combinations(_GROUPS, 2)]


def fingerprint_of(text: str, shingle: int = 3) -> int:
    """The fingerprint of one text as an unsigned number; without words zero."""
    words = text.encode().lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    if len(words) < shingle:
        shingles: Iterable[bytes] = [b" ".join(words)]
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(words) - shingle + 1
    hashes = map(partial(xxhash.xxh64_intdigest, seed=42), shingles)
    votes = np.zeros(BITS, np.int64)
    for start in range(0, n, _HASHED_AT_ONCE):
        part = np.fromiter(hashes, np.uint64, min(_HASHED_AT_ONCE, n - start))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, POSITIONS), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 3,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``doc_id, fingerprint`` (signed long) of every whole text, and the columns of ``extra``.

    Null counts as empty, whose fingerprint is zero.
    """
    prepare_workers(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(column: pd.Series) -> pd.Series:
        values = np.array([fingerprint_of(t, shingle) for t in texts_of(column)], np.uint64)
        return pd.Series(values.view(np.int64))

    more = [c.alias(n) for n, c in (extra or {}).items()]
    return docs.select(F.col(id_column).alias("doc_id"), simhash(F.col(text_column)).alias("fingerprint"), *more)


def links(values: DataFrame, paired: int = PAIRED, listed: int = LISTED) -> DataFrame:
    """Links ``a, b`` that connect what lies within two bits, given different fingerprints (this starts jobs).

    Not every pair is returned, but every pair within two bits is connected
    through the links of a list in which both are.
    """
    spark = values.sparkSession
    prepare_workers(spark)
    keys = [
        F.struct(F.lit(i).alias("list"), F.col("fingerprint").bitwiseAND(F.lit(_mask(p))).alias("key"))
        for i, p in enumerate(_LISTS)
    ]
    members = values.select("fingerprint", F.explode(F.array(*keys)).alias("at")).select("at.*", "fingerprint")
    too_long = written(
        members.groupBy("list", "key").count().where(F.col("count") > listed).select("list", "key"), "long-lists"
    )
    if too_long.isEmpty():
        return _linked(members, paired)
    short = members.join(too_long, ["list", "key"], "left_anti")
    deeper = []
    for i, fixed in enumerate(_LISTS):
        for more in combinations([p for p in range(POSITIONS) if p not in fixed], MATCHES - len(fixed)):
            deeper.append((i, _mask(fixed + more)))
    again = (
        members.join(too_long, ["list", "key"], "left_semi")
        .join(F.broadcast(spark.createDataFrame(deeper, "list int, bits long")), "list")  # 36 rows
        .select(F.col("bits").alias("list"), F.col("fingerprint").bitwiseAND(F.col("bits")).alias("key"), "fingerprint")
    )
    return _linked(short, paired).unionByName(_linked(again, paired))


def _linked(members: DataFrame, paired: int) -> DataFrame:
    bits = [_mask(p) for p in _LISTS]

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run, fixed in _whole_lists(batches):
            mask = bits[fixed] if 0 <= fixed < len(bits) else fixed
            a, b = _link_list(run, mask, paired)
            if len(a):
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = members.withColumn("list", F.col("list").cast("long")).repartition("list", "key")
    return dealt.sortWithinPartitions("list", "key", "fingerprint").mapInPandas(link, "a long, b long")


def _whole_lists(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, int]]:
    """Lists of two or more members with their list number; batches may cut a list.

    Lists of exactly two are the bulk, so those of one batch come together, as
    the rows of a table with two columns.
    """
    names = ["list", "key", "fingerprint"]
    held = [np.empty(0, np.int64)] * 3
    for batch in chain(batches, [None]):
        new = [np.empty(0, np.int64)] * 3 if batch is None else [batch[c].to_numpy(np.int64) for c in names]
        lists, keys, values = (np.concatenate(x) for x in zip(held, new))
        cuts = np.flatnonzero((lists[1:] != lists[:-1]) | (keys[1:] != keys[:-1])) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(values)]
        if batch is not None:  # the last list may go on
            held = [x[starts[-1] :] for x in (lists, keys, values)]
            starts, ends = starts[:-1], ends[:-1]
        values = values.view(np.uint64)
        twos = starts[ends - starts == 2]
        for kind in np.unique(lists[twos]):
            at = twos[lists[twos] == kind]
            yield np.stack([values[at], values[at + 1]], axis=1), int(kind)
        more = ends - starts > 2
        for start, end in zip(starts[more], ends[more]):
            yield values[start:end], int(lists[start])


def _near(x: np.ndarray) -> np.ndarray:
    """Pairs, given as exclusive ors, with enough shared bytes and few enough different bits."""
    tally = sum(((x >> np.uint64(8 * p)) & np.uint64(0xFF)) == 0 for p in range(POSITIONS))
    kept = tally >= MATCHES
    kept[kept] = np.bitwise_count(x[kept]) <= DISTANCE
    return kept


def _link_list(run: np.ndarray, mask: int, paired: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one list, or of many lists of two."""
    if run.ndim == 2:
        near = _near(run[:, 0] ^ run[:, 1])
        return run[near, 0], run[near, 1]
    if len(run) <= paired:
        i, j = np.nonzero(np.triu(_near(run[:, None] ^ run[None, :]), 1))
    else:
        i, j = _met_at_midpoints(run, mask)
    labels = _least_labels(len(run), i, j)
    moved = np.flatnonzero(labels != np.arange(len(run)))
    return run[moved], run[labels[moved]]


def _met_at_midpoints(run: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Each member with the first one that shares a midpoint, over the bits that ``mask`` leaves open."""
    flips = np.array([0] + [1 << b for b in range(BITS) if not (mask >> b) & 1], np.uint64)
    middles = (run[:, None] ^ flips[None, :]).ravel()
    owners = np.repeat(np.arange(len(run)), len(flips))
    order = np.argsort(middles, kind="stable")
    middles, owners = middles[order], owners[order]
    first = np.r_[True, middles[1:] != middles[:-1]]
    leader = owners[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
    apart = leader != owners
    return leader[apart], owners[apart]


def _least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member reachable from each of n members, over links i-j."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[i], labels[j])
        if not ((labels[i] != low).any() or (labels[j] != low).any()):
            return labels
        # Roots take the lesser label too, so whole trees move.
        for side in (labels[i], labels[j], i, j):
            np.minimum.at(labels, side, low)
        while (jumped := labels[labels] != labels).any():
            labels[jumped] = labels[labels[jumped]]


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row (this starts jobs).

    ``fingerprint`` is a signed long.  Documents within two bits are linked;
    ``component_id`` is the least doc_id reachable.  Equal fingerprints are one
    node of the graph, so copies cost no pairs.  Null and wordless texts have
    fingerprint zero and are linked like others; repeated rows are kept; a null
    doc_id keeps its row and is never a component_id unless it is alone with
    its kind.  Other columns are not looked at.
    """
    marked = written(fingerprints(docs, id_column, text_column), "fingerprints")
    rooted = _rooted(marked)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # Both written, so that the joins read plain tables and a hot component can be split.
    members = written(rooted.join(written(least, "components"), "root").select("fingerprint", "component_id"), "members")
    return marked.join(members, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _rooted(marked: DataFrame) -> DataFrame:
    """``fingerprint, least, root``: the least doc_id of each fingerprint, and the root of its component; written."""
    nodes = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(links(nodes.select("fingerprint")))
    rooted = (
        nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
        .select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    )
    return written(rooted, "rooted")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component (this starts jobs).

    It is the one with the least doc_id; rows without a doc_id come last, and of
    different texts of one doc_id the one with the least digest is first.  So
    rows that repeat a doc_id lose no text that is in no other component, and the
    same rows stay in every partitioning; of rows that repeat both doc_id and
    text one stays, the least by a hash of all its columns (maps left out).
    All columns stay; an empty table gives no rows.
    """
    digest = F.md5(F.coalesce("text", F.lit("")))
    keyed = docs.withColumn("__digest", digest)
    marked = written(fingerprints(docs, extra={"digest": digest}), "fingerprints")
    rows = marked.join(_rooted(marked).select("fingerprint", "root"), "fingerprint")
    texts = rows.groupBy("root", "doc_id", "digest").count()
    # A copy of most rows: one for each document of a component, pre-aggregated before the shuffle.
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "digest", "count")).alias("first")
    kept = texts.groupBy("root").agg(first).select(
        F.col("first.doc_id").alias("__kept"), F.col("first.digest").alias("__kept_digest"), (F.col("first.count") > 1).alias("__repeats")
    )
    kept = written(kept, "kept")
    # The kept ids grow with the documents: the same plan at every size, never a broadcast of them.
    same = keyed["doc_id"].eqNullSafe(F.col("__kept")) & (F.col("__digest") == F.col("__kept_digest"))
    left = keyed.join(kept.select("__kept", "__kept_digest").hint("merge"), same, "left_semi")
    if not kept.where("__repeats").isEmpty():
        told = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]
        order = Window.partitionBy("doc_id", "__digest").orderBy(F.xxhash64(*told))
        left = left.withColumn("__place", F.row_number().over(order)).where("__place = 1")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
