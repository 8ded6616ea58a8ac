"""Bounded-space online packing of token sequences into windows of one length.

Each partition tokenizes its documents and packs them as they come, with a
fixed number of open windows.  Whole windows are cut off a document; the rest
goes to the open window that it leaves fullest (best fit).  If it fits in none
and no more may be opened, the fullest window is topped up with the head of the
piece and emitted, and the rest is placed again.  What is left open at the end
of a partition is packed again by the same rules, a fixed number of partitions
at a time, until one task of bounded size merges the last windows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from topshare.llm.common import prepare_workers, texts_of, written

OPEN_WINDOWS = 64
#: Partitions whose leftovers one task of the next round packs.
MERGED = 32
#: Texts with a block of so many white-space characters go through ``tokenizers``: ``tiktoken`` panics at runs of a million.
LONG_SPACE = 100_000
_ID_BYTES = 4
_END_OF_DOCUMENT = bytes(_ID_BYTES)  # id 0

SCHEMA = (
    "doc_id {id}, start long, length long, doc_tokens long, ids binary,"
    " sequence_id long, offset long, left_in long"
)
_COLUMNS = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset", "left_in"]


class Piece(NamedTuple):
    doc_id: object
    start: int
    length: int
    doc_tokens: int
    ids: bytes | memoryview

    def cut(self, at: int) -> tuple[Piece, Piece]:
        head, tail = self.ids[: at * _ID_BYTES], self.ids[at * _ID_BYTES :]
        return (
            Piece(self.doc_id, self.start, at, self.doc_tokens, head),
            Piece(self.doc_id, self.start + at, self.length - at, self.doc_tokens, tail),
        )


class OnlinePacker:
    """The open windows of one partition; :attr:`rows` collects what is emitted."""

    def __init__(self, window: int, open_windows: int, first_id: int):
        self._window = window
        self._most = open_windows
        self._next_id = first_id
        self._open: dict[int, list[Piece]] = {}
        self._free: list[tuple[int, int]] = []  # free ids and slot, in order
        self._slot = 0
        self.rows: list[tuple] = []

    def add(self, piece: Piece) -> None:
        # Slices of a view are no copies, so a document is cut in time that is linear in its length.
        piece = piece._replace(ids=memoryview(piece.ids))
        while piece.length >= self._window:
            head, piece = piece.cut(self._window)
            self._emit([head])
        # What waits in a window doesn't hold the rest of its document.
        piece = piece._replace(ids=bytes(piece.ids))
        while piece.length:
            fit = bisect_left(self._free, (piece.length, -1))
            if fit < len(self._free):
                free, slot = self._free.pop(fit)
                self._open[slot].append(piece)
                if free == piece.length:
                    self._emit(self._open.pop(slot))
                else:
                    insort(self._free, (free - piece.length, slot))
                return
            if len(self._free) < self._most:
                self._slot += 1
                self._open[self._slot] = [piece]
                insort(self._free, (self._window - piece.length, self._slot))
                return
            free, slot = self._free.pop(0)
            head, piece = piece.cut(free)
            self._emit([*self._open.pop(slot), head])

    def left(self) -> Iterator[Piece]:
        """The pieces of the open windows, the fullest first."""
        for _, slot in self._free:
            yield from self._open[slot]

    def merge_all(self) -> None:
        """Fill windows one after another with all that is left; at most the last is short."""
        held, free = [], self._window
        for piece in list(self.left()):
            while piece.length >= free:
                head, piece = piece.cut(free)
                self._emit([*held, head])
                held, free = [], self._window
            if piece.length:
                held.append(piece)
                free -= piece.length
        if held:
            self._emit(held)
        self._open, self._free = {}, []

    def _emit(self, pieces: Iterable[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.rows.append((*p[:-1], bytes(p.ids), self._next_id, offset, None))
            offset += p.length
        self._next_id += 1


class ByteLevelEncoder:
    """The ids that ``tokenizers`` gives for a byte-level BPE file without special tokens added.

    The merges are run by ``tiktoken``, several times as fast, with the file's
    own vocabulary: ids of byte-level files are in order of merges, so they are
    the ranks.  Texts in which a special token is spelled out go through
    ``tokenizers``, which alone cuts these first, and so do texts with a very
    long run of white space, on which ``tiktoken`` panics.
    """

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self._tokenizer.get_added_tokens_decoder().values()}
        plain = _byte_values()
        ranks = {
            bytes(plain[c] for c in token): i for token, i in self._tokenizer.get_vocab().items() if token not in special
        }
        self._special = tuple(special)
        self._merger = tiktoken.Encoding(
            path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if any(s in text for s in self._special) or _has_long_space(text):
            ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self._merger.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


def _has_long_space(text: str) -> bool:
    """Whether an aligned block of ``LONG_SPACE`` characters is white space, as in every run of twice that length."""
    return any(text[i : i + LONG_SPACE].isspace() for i in range(0, len(text) - LONG_SPACE + 1, LONG_SPACE))


def _byte_values() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: visible Latin-1 stands for itself, the rest from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


_ENCODERS: dict[str, ByteLevelEncoder] = {}


def _encoder(path: str) -> ByteLevelEncoder:
    """One encoder for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteLevelEncoder(path)
    return _ENCODERS[path]


def _documents(batches: Iterator[pd.DataFrame], path: str) -> Iterator[list[Piece]]:
    encoder = _encoder(path)
    for batch in batches:
        pieces = []
        for doc_id, text in zip(batch["doc_id"].array, texts_of(batch["text"])):
            ids = encoder.ids(text) + _END_OF_DOCUMENT
            n = len(ids) // _ID_BYTES
            pieces.append(Piece(None if pd.isna(doc_id) else doc_id, 0, n, n, ids))
        yield pieces


def _leftovers(batches: Iterator[pd.DataFrame]) -> Iterator[list[Piece]]:
    for batch in batches:
        yield [
            Piece(None if pd.isna(d) else d, int(s), int(n), int(t), i)
            for d, s, n, t, i in zip(batch["doc_id"].array, batch["start"], batch["length"], batch["doc_tokens"], batch["ids"])
        ]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = 1024,
    open_windows: int = OPEN_WINDOWS,
    merged: int = MERGED,
) -> DataFrame:
    """Pack every whole text into windows of ``window`` ids (this starts jobs).

    One row per piece: ``doc_id, start, length, doc_tokens, ids`` (little-endian
    32-bit numbers), ``sequence_id, offset``.  Each document ends with id 0.
    Every sequence but the last merged one is full; pad that one when reading.

    A null text is an empty one (only id 0).  Repeated rows are packed as often
    as they come; a null doc_id stays null.  An empty table gives no rows.
    Other columns are not looked at.  ``tokenizer_path`` has to be readable on
    every executor.
    """
    prepare_workers(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    schema = SCHEMA.format(id=kind)

    def packed(read, number: int, last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            partition = TaskContext.get().partitionId()
            packer = OnlinePacker(window, open_windows, (number << 56) + (partition << 32))
            for pieces in read(batches):
                for piece in pieces:
                    packer.add(piece)
                yield _frame(packer.rows)
                packer.rows = []
            if last:
                packer.merge_all()
                yield _frame(packer.rows)
            else:
                yield _frame([(*p, None, None, partition) for p in packer.left()])

        return run

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    first = source.mapInPandas(packed(lambda batches: _documents(batches, tokenizer_path), 0, False), schema)
    # Written whole, so that what is emitted and what is left come from one run of each task.
    table = written(first, "packed", compression="zstd")
    rounds = [table.where(F.col("left_in").isNull())]
    number = 0
    while True:
        left = table.where(F.col("left_in").isNotNull())
        partitions = left.select("left_in").distinct().count()
        if not partitions:
            break
        number += 1
        last = partitions <= merged
        groups = -(-partitions // merged)
        dealt = left.repartition(1) if last else left.repartition(groups, F.floor(F.col("left_in") / merged))
        again = dealt.sortWithinPartitions("left_in", "doc_id", "start").mapInPandas(packed(_leftovers, number, last), schema)
        table = written(again, "packed", compression="zstd")
        rounds.append(table.where(F.col("left_in").isNull()))
    result = rounds[0]
    for more in rounds[1:]:
        result = result.unionByName(more)
    return result.drop("left_in")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame.from_records(rows, columns=_COLUMNS)
    whole = ["start", "length", "doc_tokens", "sequence_id", "offset", "left_in"]
    return frame.astype(dict.fromkeys(whole, "Int64"))
