"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases, in Spark expressions only.

A blank line ends a section, a line break ends a paragraph, and a paragraph is
cut into phrases of up to five words; every character is in exactly one phrase.
A leaf is the SHA-256 of a phrase, and each node that of its children's digests,
so equal roots mean equal texts.  The fingerprint is text: the root, then for
each section ``/`` and the start of its digest, for each paragraph ``:`` and the
start of its digest, ``=`` and the starts of the digests of its phrases.  Where
two fingerprints differ, the branches lead to the paragraphs that do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topshare.llm.common import written

_SHORT = 8
_SECTION_END = r"(?<=\n\n)(?=[^\n])"
_PARAGRAPH_END = r"(?<=\n)(?=[^\n])"
_PHRASE = r"\s*+(?:\S++\s*+){1,5}+|\s++"


def _digest(kind: str, parts: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), F.array_join(parts, "")), 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, _SHORT)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a whole text; null counts as empty."""
    sections = F.split(F.coalesce(text, F.lit("")), _SECTION_END)
    leaves = F.transform(
        sections,
        lambda s: F.transform(
            F.split(s, _PARAGRAPH_END),
            lambda p: F.transform(F.regexp_extract_all(p, F.lit(_PHRASE), F.lit(0)), lambda x: F.sha2(x, 256)),
        ),
    )
    # The digest and the shown form of each node, from the leaves up.
    paragraphs = F.transform(
        leaves,
        lambda s: F.transform(
            s,
            lambda p: F.struct(
                _digest("p", p).alias("digest"), F.array_join(F.transform(p, _short), "").alias("shown")
            ),
        ),
    )
    nodes = F.transform(
        paragraphs,
        lambda s: F.struct(
            _digest("s", s["digest"]).alias("digest"),
            F.array_join(
                F.transform(s, lambda p: F.concat(F.lit(":"), _short(p["digest"]), F.lit("="), p["shown"])), ""
            ).alias("shown"),
        ),
    )
    # One pass over the finished sections gives both the root and the shown branches.
    return F.transform(
        F.array(nodes),
        lambda n: F.concat(
            _digest("r", n["digest"]),
            F.array_join(F.transform(n, lambda s: F.concat(F.lit("/"), _short(s["digest"]), s["shown"])), ""),
        ),
    )[0]


def root(print_: Column) -> Column:
    return F.substring(print_, 1, 64)


def leaves_of(print_: Column) -> Column:
    """The different phrases of a fingerprint."""
    joined = F.regexp_replace(print_, r"^[^/]*+|/[0-9a-f]*+|:[0-9a-f]*+=", "")
    return F.array_distinct(F.regexp_extract_all(joined, F.lit(f".{{{_SHORT}}}"), F.lit(0)))


def likeness(equal: Column, leaves: Column, other_leaves: Column) -> Column:
    """1 for equal roots, else twice the shared phrases over the phrases of both, different ones only."""
    total = F.size(leaves) + F.size(other_leaves)
    shared = 2.0 * F.size(F.array_intersect(leaves, other_leaves)) / total
    return F.when(equal, 1.0).when(total == 0, 0.0).otherwise(shared)


def edited_paragraphs(before: Column, after: Column) -> Column:
    """Where two fingerprints differ: an array of structs ``section, paragraph``, both from 0.

    Only sections whose digests differ are descended into.
    """
    ours, theirs = (F.split(x, "/") for x in (before, after))
    sections = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(ours), F.size(theirs))),
        lambda i: ~F.get(ours, i).eqNullSafe(F.get(theirs, i)),
    )

    def paragraphs(i: Column) -> Column:
        a = F.split(F.coalesce(F.get(ours, i), F.lit("")), ":")
        b = F.split(F.coalesce(F.get(theirs, i), F.lit("")), ":")
        places = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(a), F.size(b))), lambda j: ~F.get(a, j).eqNullSafe(F.get(b, j))
        )
        return F.transform(places, lambda j: F.struct((i - 1).alias("section"), (j - 1).alias("paragraph")))

    return F.flatten(F.transform(sections, paragraphs))


_KEYS = ["no_id", "id", "digest"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with plain keys: no null among them, and different texts of one doc_id apart.

    The keys hold the doc_id, so both uses of this frame need the same columns
    and share one shuffle of the texts.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        text.alias("text"),
        F.isnull("doc_id").alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64(text).alias("digest"),
    )


def _followers(keyed: DataFrame) -> DataFrame:
    """For each document its keys and, as ``before``, keys and length of the document that it follows in the ring.

    The ring is in descending order of doc_id, then by text; the first follows
    the last.  Keys are range-partitioned and linked inside each range; the ends
    of the ranges, a row for each, are linked apart (this starts a job).
    """
    keys = keyed.select(*_KEYS, F.char_length("text").alias("n_chars")).groupBy(*_KEYS).agg(F.max("n_chars").alias("n_chars"))
    order = [F.asc("no_id"), F.desc("id"), F.asc("digest")]
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = written(
        keys.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ring-ranges"
    )
    inside = Window.partitionBy("range").orderBy(*order)
    here = F.struct(*_KEYS, "n_chars")
    linked = written(
        ranges.withColumn("before", F.lag(here).over(inside)).withColumn("last", F.lead("id").over(inside).isNull()),
        "ring-links",
    )
    across = Window.orderBy("range")  # one row for each range
    ends = linked.where("last").select("range", here.alias("end"))
    ends = ends.select(
        "range", F.coalesce(F.lag("end").over(across), F.last("end").over(across.rowsBetween(0, Window.unboundedFollowing))).alias("end")
    )
    firsts = linked.where("before IS NULL").join(ends, "range").select(*_KEYS, F.col("end").alias("before"))
    return firsts.unionByName(linked.where("before IS NOT NULL").select(*_KEYS, "before"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of an edited one, with likenesses (this starts jobs).

    The edited text has its last third replaced by the head of the next document
    in descending order of doc_id; after the last comes the first.  Null texts
    are empty; rows without doc_id come last in the ring; rows that repeat both
    doc_id and text are one document there, and each gets the same result; an
    empty table gives no rows.  Other columns are not looked at.

    Texts are shuffled once, by key; only heads and fingerprints move on to the
    document before.
    """
    keyed = _keyed(docs)
    third = F.floor(F.col("before.n_chars") / 3).cast("int")
    # Copies of a row give the same head: one is enough.
    heads = (
        keyed.join(_followers(keyed), _KEYS)
        .select(
            *[F.col(f"before.{k}").alias(k) for k in _KEYS],
            F.substr("text", F.lit(1), third).alias("head"),
            fingerprint(F.col("text")).alias("next_fingerprint"),
        )
    )
    joined = keyed.join(heads.dropDuplicates(_KEYS), _KEYS)
    n = F.char_length("text")
    kept = n - F.floor(n / 3).cast("int")
    edited = joined.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        "text",
        F.concat(F.substr("text", F.lit(1), kept), "head").alias("edited"),
        "next_fingerprint",
    )
    prints = edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        "next_fingerprint",
    )
    columns = ["fingerprint", "edited_fingerprint", "next_fingerprint"]
    leaves = prints.select("*", *[leaves_of(F.col(c)).alias(f"{c}_leaves") for c in columns])

    def near(other: str) -> Column:
        equal = root(F.col("fingerprint")) == root(F.col(other))
        return likeness(equal, F.col("fingerprint_leaves"), F.col(f"{other}_leaves"))

    return leaves.select(
        *prints.drop("next_fingerprint").columns,
        near("edited_fingerprint").alias("near_edited"),
        near("next_fingerprint").alias("near_next"),
    )
