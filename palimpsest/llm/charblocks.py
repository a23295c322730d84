"""Whole texts as flat numpy arrays of code points, for use inside tasks.

Short texts are put together and long ones cut into pieces, so that the arrays stay below
a fixed size however many or long the texts of an Arrow batch are.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np

#: Most code points in a block.
BLOCK = 1 << 19
_CUT = re.compile(r"[.!?\n。！？](?!.*[.!?\n。！？])", re.S)
_MIX1, _MIX2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For the code points below 0x10000: the lower-case form where that is one character, and whether it is a letter."""
    chars = [chr(i) for i in range(0x10000)]
    lower = np.array([ord(low) if len(low := c.lower()) == 1 else i for i, c in enumerate(chars)], np.uint32)
    return lower, np.array([c.isalpha() for c in chars])


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a polynomial hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class Block:
    """Some texts, or a piece of one: ``cp`` holds their lower-cased code points, each text followed by a line feed.

    ``rows[i]`` is the text that piece ``i`` belongs to, ``starts[i]`` its place in ``cp``
    and ``offsets[i]`` the number of code points of that text before the piece.
    """

    def __init__(self, rows: list[int], pieces: list[str], offsets: list[int]):
        raw = np.frombuffer("\n".join([*pieces, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        lower, letters = tables()
        low = np.minimum(raw, 0xFFFF)
        self.cp = np.where(raw < 0x10000, lower[low], raw)
        self.raw = raw
        self.letter = letters[low]
        if (far := raw >= 0x10000).any():
            self.letter[far] = [chr(x).isalpha() for x in raw[far]]
        self.rows, self.offsets = np.array(rows), np.array(offsets)
        sizes = np.array([len(p) + 1 for p in pieces])
        self.starts = np.cumsum(sizes) - sizes

    def sums(self, values: np.ndarray) -> np.ndarray:
        """``values`` (one for each code point) added up for each piece."""
        return np.add.reduceat(values, self.starts)

    def prefix_hash(self, weights: np.ndarray | None = None) -> np.ndarray:
        """Cumulative polynomial hash of ``weights`` (the code points if none); differences of it give substring hashes."""
        h = np.zeros(len(self.cp) + 1, np.uint64)
        values = (self.cp if weights is None else weights).astype(np.uint64) + np.uint64(1)
        np.cumsum(values * powers(2 * BLOCK)[0][: len(self.cp)], out=h[1:])
        return h

    def hash_between(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the substrings ``[start, end)``, the same wherever the substring stands."""
        return mix((h[end] - h[start]) * powers(2 * BLOCK)[1][start])


def blocks(texts: list[str | None], overlap: int = 0) -> Iterator[Block]:
    """The non-null texts as blocks of at most about ``BLOCK`` code points.

    A text above that size is cut after the last sentence end of each piece, or within a
    sentence of over ``BLOCK`` characters; ``overlap`` repeats that many characters of the
    piece before.
    """
    rows: list[int] = []
    pieces: list[str] = []
    offsets: list[int] = []
    size = 0
    for row, text in enumerate(texts):
        if text is None:
            continue
        at = 0
        while True:
            piece = text[at : at + BLOCK]
            if at + BLOCK < len(text):
                tail = _CUT.search(piece, len(piece) - min(len(piece), 1 << 14))
                piece = piece[: tail.end()] if tail and tail.end() > overlap else piece
            if rows and size + len(piece) > BLOCK:
                yield Block(rows, pieces, offsets)
                rows, pieces, offsets, size = [], [], [], 0
            rows.append(row)
            pieces.append(piece)
            offsets.append(at)
            size += len(piece) + 1
            if at + len(piece) >= len(text):
                break
            at += len(piece) - overlap
    if rows:
        yield Block(rows, pieces, offsets)
