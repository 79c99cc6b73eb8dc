"""Words of whole texts as 64-bit ids, worked out for many texts at once.

A word is a longest run of bytes other than blank, tab, line feed, vertical
tab, form feed and carriage return, with A-Z as a-z. In UTF-8 these bytes never
stand inside another character, so bytes and characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Texts are handled in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers can be undone
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass
class _Powers:
    """Powers of the hash base and of its inverse, as far as a text has needed them."""

    up: np.ndarray
    down: np.ndarray

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, GROUP_BYTES)
            with np.errstate(over="ignore"):
                for name, base in (("up", _STEP), ("down", _STEP_BACK)):
                    table = np.full(n, base, np.uint64)
                    table[0] = 1
                    setattr(self, name, np.multiply.accumulate(table))


_POWERS = _Powers(np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def mixed(ids: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit ids evenly; another seed gives another, unrelated spread."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of a group of texts: `ids` in reading order, those of text i at `first[i]:first[i + 1]`."""

    ids: np.ndarray
    first: np.ndarray
    #: The group's bytes, lower-cased, each text followed by a blank, and the place of each text in them.
    data: np.ndarray
    place: np.ndarray

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def groups(texts: Iterable[str | None], most: int = GROUP_BYTES) -> Iterator[list[bytes]]:
    """UTF-8 of texts (null: empty), in groups of about `most` bytes."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode()
        if held and size + len(raw) > most:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held


def span_ids(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ids of byte spans: equal bytes have equal ids, wherever they stand."""
    _POWERS.reach(len(data))
    with np.errstate(over="ignore"):
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS.up[: len(data)], dtype=np.uint64)
        upto = np.where(begin > 0, sums[np.maximum(begin, 1) - 1], np.uint64(0))
        return mixed((sums[end - 1] - upto) * _POWERS.down[begin])


def words_of(texts: list[bytes], marks: bool = False) -> Words:
    """All words of some texts. With `marks`, ASCII punctuation parts words as white space does."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    place = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    if marks:
        inside = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    else:
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(span_ids(data, begin, end), np.searchsorted(begin, place).astype(np.int64), data, place)


def joined(words: Words, gaps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of word groups that stand at a word and at these further places after it, and the text of each.

    `(1,)` gives pairs of neighbours, `(2,)` pairs with one word between,
    `(1, 2, 3, 4)` runs of five. None reaches beyond its text.
    """
    n, owner = len(words.ids), words.owner()
    reach = max(gaps)
    if n <= reach:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kept = np.flatnonzero(owner[: n - reach] == owner[reach:])
    out = words.ids[kept]
    with np.errstate(over="ignore"):
        for i, gap in enumerate(gaps):
            out = mixed(out * np.uint64(2 * gap + 3), i + 1) + words.ids[kept + gap]
    return mixed(out), owner[kept]
