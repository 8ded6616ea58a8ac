"""Memory of encoded words, for byte-level BPE whose pattern lets a space begin a token.

Where a single space or line break stands between two characters that are no
white space, the pattern always ends a match before it.  The space then begins
the next match, while the line break is a match of its own.  So a text of such
words may be cut there, and a word encodes alike wherever it stands, with its
space or, at the start of a line, without.  A worker remembers what the words
that it has seen encode to; texts with any other white space are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

#: Words of one generation; two are held, so this bounds a worker's memory.
REMEMBERED = 150_000
#: Texts with longer words are encoded whole.
_LONGEST = 256


class WordMemory:
    """The ids of texts as little-endian 32-bit numbers.

    ``encode_words`` gives the ids of each of some words (with or without a
    leading space), ``encode_text`` those of any text.
    """

    def __init__(
        self,
        encode_words: Callable[[Sequence[str]], Sequence[bytes]],
        encode_text: Callable[[str], bytes],
        remembered: int = REMEMBERED,
    ):
        self._encode_words = encode_words
        self._encode_text = encode_text
        self._line_break = encode_text("\n")
        self._remembered = remembered
        # Words after a space and words at the start of a line, each with the generation before.
        self._spaced: dict[str, bytes] = {}
        self._first: dict[str, bytes] = {}
        self._older_spaced: dict[str, bytes] = {}
        self._older_first: dict[str, bytes] = {}

    def ids(self, texts: Sequence[str]) -> list[bytes]:
        if len(self._spaced) + len(self._first) > self._remembered:
            self._older_spaced, self._older_first = self._spaced, self._first
            self._spaced, self._first = {}, {}
        cut: list[list[list[str]] | None] = []
        spaced: set[str] = set()
        first: set[str] = set()
        for text in texts:
            lines = [line.split(" ") for line in text.split("\n")]
            new_spaced: set[str] = set()
            for words in lines:
                new_spaced.update(words[1:])
            new_spaced = new_spaced.difference(self._spaced)
            new_first = {words[0] for words in lines}.difference(self._first)
            if _plain(new_spaced) and _plain(new_first - {""}) and _single_breaks(lines):
                cut.append(lines)
                spaced |= new_spaced
                first |= new_first
            else:
                cut.append(None)
        self._learn(spaced, self._spaced, self._older_spaced, " ")
        self._learn(first, self._first, self._older_first, "")
        return [self._encode_text(t) if lines is None else self._joined(lines) for t, lines in zip(texts, cut)]

    def _joined(self, lines: list[list[str]]) -> bytes:
        spaced, first = self._spaced.__getitem__, self._first
        return self._line_break.join([first[words[0]] + b"".join(map(spaced, words[1:])) for words in lines])

    def _learn(self, words: set[str], known: dict[str, bytes], older: dict[str, bytes], lead: str) -> None:
        unknown = list(words.difference(older))
        for word in words.difference(unknown):
            known[word] = older[word]
        known.update(zip(unknown, self._encode_words([lead + w for w in unknown])))


def _plain(words: set[str]) -> bool:
    """Whether there is no white space in the words, and none is empty or very long."""
    found = list(words)
    return not found or ("\n".join(found).split() == found and max(map(len, found)) <= _LONGEST)


def _single_breaks(lines: list[list[str]]) -> bool:
    """Line breaks stand alone or in twos, and not at an end; a line is empty or begins and ends with a word."""
    empty = [words == [""] for words in lines]
    if any(words[0] == "" for words, blank in zip(lines, empty) if not blank):
        return False
    if not any(empty):
        return True
    return len(lines) == 1 or not (empty[0] or empty[-1] or any(a and b for a, b in zip(empty, empty[1:])))
