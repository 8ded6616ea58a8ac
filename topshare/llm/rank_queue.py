"""Byte-level BPE with a rank queue on a hierarchical bitmap.

Each pair of neighbouring parts that could be merged waits in the bucket of its
rank, as the position of its first part in a linked list.  A bitmap over the
buckets, with a bitmap over its words and a top word over those, gives the
lowest rank by find-first-set, whatever the number of pairs.  Entries whose pair
has changed meanwhile are skipped when they come up.  Every step is constant
but for the order inside a bucket, so long pre-tokens cost about as much a byte
as short ones.  The pre-tokens of many texts share a queue: a bucket that many
of them wait in is merged at once by array operations, a small one pair by pair.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topshare.llm.chunks import WordMemory
from topshare.llm.common import prepare_workers

_WORD = 6  # a bitmap word has 2 ** 6 bits
_LOW = (1 << _WORD) - 1
#: Words of one generation of a worker's memory, about 200 bytes each.
REMEMBERED = 400_000
#: From so many entries on, a bucket is merged at once by array operations, which cost about as much as so many merges.
MANY = 24
#: Bytes of Arrow batches whose texts are encoded together, if there are several.
GATHERED = 4 << 20
#: Bytes of pre-tokens that share a list and a queue, which bounds the memory that they take; a longer one goes alone.
SHARED = 1 << 18


def dated_pattern(pattern: str) -> str:
    """``pattern`` with its ``\\p{..}`` classes as the tiktoken library knows them.

    The ``regex`` module follows a later version of Unicode, in which thousands
    of code points have become letters and numbers.  The other library is asked
    for the members of each class, and what differs is taken out or added.
    """
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    for name in set(re.findall(r"\\[pP]\{\^?\w+\}", pattern)):
        other = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs = set(bytes(other.encode_ordinary(points)).decode())
        ours = set(regex.findall(name, points))
        dated = f"[{name}--[{_ranges(ours - theirs)}]]" if ours > theirs & ours else name
        pattern = pattern.replace(name, f"[{dated}[{_ranges(theirs - ours)}]]" if theirs - ours else dated)
    return pattern


def _ranges(characters: set[str]) -> str:
    """The inside of a character class, one range for each run of code points."""
    points = np.array(sorted(map(ord, characters)))
    runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1)
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)


class RankQueueBPE:
    """Encoder and decoder for one vocabulary of ranks.

    ``pattern`` cuts a text into pre-tokens, with classes of characters as in
    tiktoken; ``ranks`` maps the bytes of a token to its rank, which is its id.
    Every single byte has to be a token.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self._ranks = ranks
        self._pattern = pattern
        self._split = regex.compile(pattern).findall
        self._one = {t: i.to_bytes(4, "little") for t, i in ranks.items()}
        self._singles = np.array([ranks[bytes([b])] for b in range(256)])
        # Ranks of pairs of bytes; the value after the last rank says that there is none.
        self._none = max(ranks.values()) + 1
        self._pairs = np.full(1 << 16, self._none)
        for token, rank in ranks.items():
            if len(token) == 2:
                self._pairs[token[0] << 8 | token[1]] = rank
        self._tokens = np.full(self._none, None, object)
        for token, rank in ranks.items():
            self._tokens[rank] = token
        self._queue = RankQueue(self._none)
        self.memory = WordMemory(self._cut, lambda text: self._cut([text])[0], REMEMBERED)

    @cached_property
    def _split_dated(self) -> Callable[[str], list[str]]:
        return regex.compile(dated_pattern(self._pattern), regex.V1).findall

    @cached_property
    def _joints(self) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """Ids of two parts as one number, in order; the ranks of the tokens they make; tokens that are part of one that goes first."""
        joints, early = [(np.iinfo(np.int64).max, self._none)], set()
        for token, rank in self._ranks.items():
            for k in range(1, len(token)):
                left, right = self._ranks.get(token[:k]), self._ranks.get(token[k:])
                if left is not None and right is not None:
                    joints.append((left * self._none + right, rank))
                    early.update(part for part in (left, right) if part > rank)
        joints.sort()
        return *np.array(joints, np.int64).T.copy(), early

    def encode_batch(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        return self.memory.ids(texts)

    def decode(self, ids: Sequence[int]) -> bytes:
        at = np.asarray(ids, np.int64)
        if at.size and at.min() < 0:
            raise KeyError(int(at.min()))
        return b"".join(self._tokens[at])

    def _cut(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text; a pre-token that is a token needs no merges, the others are merged together."""
        one = self._one
        cut = []
        unknown: dict[bytes, bytes] = {}
        for text in texts:
            if text[1:].isalpha() and text[0] == " ":  # a space and letters are one pre-token
                piece = text.encode()
                cut.append(piece)
                if piece not in one:
                    unknown[piece] = b""
            else:
                split = self._split if text.isascii() else self._split_dated
                pieces = [p.encode() for p in split(text)]
                cut.append(pieces)
                for piece in pieces:
                    if piece not in one:
                        unknown[piece] = b""
        found = dict(zip(unknown, self.merge(list(unknown))))
        return [
            found.get(x) or one[x] if isinstance(x, bytes) else b"".join([found.get(p) or one[p] for p in x]) for x in cut
        ]

    def merge(self, pieces: Sequence[bytes]) -> list[bytes]:
        """The ids of each pre-token, merged in shares of about ``SHARED`` bytes."""
        ends = np.cumsum([0, *map(len, pieces)])
        merged: list[bytes] = []
        while len(merged) < len(pieces):
            start = len(merged)
            end = int(ends.searchsorted(ends[start] + SHARED, side="right")) - 1
            merged += self._merge_share(pieces[start : max(end, start + 1)])
        return merged

    def _merge_share(self, pieces: Sequence[bytes]) -> list[bytes]:
        """The ids of each pre-token: always the lowest rank, the leftmost first.

        All pre-tokens share one list and one queue; no pair crosses their
        borders, so each is merged as if it were alone.
        """
        text = b"".join(pieces)
        n = len(text)
        borders = np.cumsum([0, *map(len, pieces)])
        border = np.zeros(n + 1, bool)
        border[borders] = True
        codes = np.frombuffer(text, np.uint8)
        pairs = np.full(n, self._none)
        pairs[:-1] = self._pairs[codes[:-1].astype(np.int64) << 8 | codes[1:]]
        pairs[border[1:]] = self._none
        queue = self._queue
        mergeable = np.flatnonzero(pairs != self._none)
        queue.add_all(pairs[mergeable], mergeable)
        rank_of, none, buckets = self._ranks.get, self._none, queue.buckets
        single: set[int] = set()  # ranks whose pairs are many in few pre-tokens, and have to be merged one after the other
        # Ids and list of the parts, and ranks of the pairs that begin at a position: the same memory, by number and as arrays.
        state = [self._singles[codes], pairs, np.arange(1, n + 1), np.arange(-1, n)]
        ids, ranks, after, before = held = [array("q", a.astype(np.int64).tobytes()) for a in state]
        del state, pairs, mergeable
        parts = (*(np.frombuffer(a, np.int64) for a in held), np.cumsum(border), border)
        ends = border.tolist()
        while queue.top:
            lowest = queue.lowest()
            bucket = buckets[lowest]
            if len(bucket) >= MANY and lowest not in single:
                at = self._mergeable(lowest, bucket, parts)
                if len(at) * 2 >= len(bucket):
                    self._merge_all(lowest, at, parts)
                    if not bucket:
                        queue.drop(lowest)
                    continue
                bucket += at.tolist()
                single.add(lowest)
            if len(bucket) > 1:
                bucket.sort(reverse=True)  # mostly in order already
            lower = False
            while bucket and not lower:
                i = bucket.pop()
                if ranks[i] != lowest:
                    continue  # stale
                ids[i] = lowest
                gone = after[i]
                end = after[i] = after[gone]
                before[end] = i
                ranks[gone] = none
                ids[gone] = -1
                if ends[end]:
                    ranks[i] = none
                    changed = ()
                else:
                    ranks[i] = rank = rank_of(text[i : after[end]], none)
                    changed = ((rank, i),) if rank != none else ()
                    lower = rank < lowest
                if not ends[i]:
                    left = before[i]
                    ranks[left] = rank = rank_of(text[left:end], none)
                    if rank != none:
                        changed = (*changed, (rank, left))
                        lower = lower or rank < lowest  # goes first
                if changed:
                    queue.add(changed)
            if not bucket:
                queue.drop(lowest)
        found = parts[0]
        alive = found >= 0
        cuts = (np.r_[0, np.cumsum(alive)][borders] * 4).tolist()
        merged = found[alive].astype("<u4").tobytes()
        return [merged[a:b] for a, b in zip(cuts, cuts[1:])]

    def _mergeable(self, rank: int, bucket: list[int], parts: tuple[np.ndarray, ...]) -> np.ndarray:
        """Pairs of one rank that may be merged at once; the others stay in the bucket, but stale ones.

        Where a merge can make a pair that goes first, that is one of each pre-token.
        """
        _, ranks, after, _, pre_token, _ = parts
        at = np.array(bucket)
        at.sort()
        at = at[ranks[at] == rank]
        if rank in self._joints[2]:
            own = pre_token[at]
            chosen = np.r_[True, own[1:] != own[:-1]][: len(at)]
            bucket[:] = at[~chosen].tolist()
            return at[chosen]
        bucket.clear()
        touching = after[at[:-1]] == at[1:]
        if touching.any():  # equal parts in a row: from the left, every other pair
            index = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.r_[True, ~touching], index, 0))
            at = at[(index - first) % 2 == 0]
        return at

    def _merge_all(self, rank: int, at: np.ndarray, parts: tuple[np.ndarray, ...]) -> None:
        """Merge pairs of one rank, and queue the new pairs."""
        ids, ranks, after, before, _, border = parts
        gone = after[at]
        end = after[gone]
        ids[at] = rank
        ids[gone] = -1
        after[at] = end
        before[end] = at
        ranks[gone] = ranks[at] = self._none
        has_left = ~border[at]
        has_left[1:] &= end[:-1] != at[1:]  # that pair is the right one of the merge before
        left = before[at[has_left]]
        ranks[left] = self._none
        first = np.concatenate((at[~border[end]], left))
        joint, makes, _ = self._joints
        wanted = ids[first] * self._none + ids[after[first]]
        places = joint.searchsorted(wanted)
        known = joint[places] == wanted
        first, new = first[known], makes[places[known]]
        ranks[first] = new
        if len(new) < 8 * MANY:
            self._queue.add(zip(new.tolist(), first.tolist()))
        else:
            self._queue.add_all(new, first)


class RankQueue:
    """Positions in buckets by rank; bits of the buckets, of 64 words of them, and of all those give the lowest rank."""

    def __init__(self, ranks: int):
        words = (ranks >> _WORD) + 1
        self._words = [0] * words
        self._groups = [0] * ((words >> _WORD) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def lowest(self) -> int:
        top = self.top
        group = (top & -top).bit_length() - 1
        bits = self._groups[group]
        word = group << _WORD | (bits & -bits).bit_length() - 1
        bits = self._words[word]
        return word << _WORD | (bits & -bits).bit_length() - 1

    def add(self, entries: Iterable[tuple[int, int]]) -> None:
        """Entries are ranks with positions."""
        buckets = self.buckets
        for rank, at in entries:
            waiting = buckets.get(rank)
            if waiting is not None:
                waiting.append(at)
            else:
                buckets[rank] = [at]
                self._mark(rank)

    def drop(self, rank: int) -> None:
        """Remove an empty bucket."""
        del self.buckets[rank]
        word = rank >> _WORD
        self._words[word] ^= 1 << (rank & _LOW)
        if not self._words[word]:
            group = word >> _WORD
            self._groups[group] ^= 1 << (word & _LOW)
            if not self._groups[group]:
                self.top ^= 1 << group

    def add_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """``add`` for many entries, with one step for each rank among them."""
        order = np.argsort(ranks.astype(np.uint16) if len(self._words) <= 1 << 16 - _WORD else ranks, kind="stable")
        sorted_ranks, sorted_positions = ranks[order], positions[order].tolist()
        starts = np.flatnonzero(np.r_[True, sorted_ranks[1:] != sorted_ranks[:-1]][: len(order)])
        ends = [*starts[1:].tolist(), len(order)]
        for rank, start, end in zip(sorted_ranks[starts].tolist(), starts.tolist(), ends):
            waiting = self.buckets.get(rank)
            if waiting is not None:
                waiting += sorted_positions[start:end]
            else:
                self.buckets[rank] = sorted_positions[start:end]
                self._mark(rank)

    def _mark(self, rank: int) -> None:
        word = rank >> _WORD
        self._words[word] |= 1 << (rank & _LOW)
        self._groups[word >> _WORD] |= 1 << (word & _LOW)
        self.top |= 1 << (word >> _WORD)


_ENCODERS: dict[tuple[str, str], RankQueueBPE] = {}


def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> RankQueueBPE:
    """One encoder for each worker and rank file (lines of base64 and rank)."""
    if (path, pattern) not in _ENCODERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[path, pattern] = RankQueueBPE(ranks, pattern)
    return _ENCODERS[path, pattern]


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about ``GATHERED`` bytes: more words at once make fuller buckets."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > GATHERED:
            yield held
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield held


def encode(docs: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) of every whole text, without special tokens.

    A null text is an empty one and has no ids; repeated rows and null ids stay;
    other columns are not looked at.  ``ranks_path`` has to be readable on every
    executor.
    """
    prepare_workers(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path)
        for gathered in _gathered(batches):
            ids = bpe.encode_batch([t or "" for batch in gathered for t in batch.column(1).to_pylist()])
            ends = np.cumsum([0] + [len(i) // 4 for i in ids]).astype(np.int32)
            values = np.frombuffer(b"".join(ids), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))
            start = 0
            for batch in gathered:
                yield pa.RecordBatch.from_arrays([batch.column(0), lists.slice(start, len(batch))], ["doc_id", "ids"])
                start += len(batch)

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(ids: Column, ranks_path: str) -> Column:
    """The bytes that some ids stand for."""

    @F.pandas_udf("binary")
    def joined(column: pd.Series) -> pd.Series:
        bpe = encoder(ranks_path)
        return pd.Series([bpe.decode(i) for i in column])

    return joined(ids)
