"""Word boundaries and word hashes of many texts at once, as numpy arrays.

The texts of a chunk are laid end to end.  A word's hash is a polynomial over its bytes modulo 2^64, taken from one
running sum, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np

CHUNK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

# Bytes outside these classes are part of a word.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALPHANUMERIC = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def byte_classes(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Two tables over the 256 bytes: the byte after lower-casing A-Z if asked, and whether it belongs to a word."""
    to = np.arange(256, dtype=np.uint8)
    if lower:
        to[0x41:0x5B] += 32
    inside = np.ones(256, dtype=bool)
    inside[list(separators)] = False
    return to, inside[to]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit integers over all their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the multiplier and of its inverse, as far as a chunk needed them yet."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + 4096)
            for name, base in (("up", _ODD), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


class Words(NamedTuple):
    """The words of a chunk of texts: byte ranges in ``buffer``, 64-bit hashes and the text each belongs to."""

    buffer: np.ndarray
    bounds: np.ndarray  # text i is buffer[bounds[i] : bounds[i + 1] - 1]
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=len(self.bounds) - 1)

    def bytes(self, word: int) -> bytes:
        return self.buffer[self.start[word] : self.end[word]].tobytes()


def words_of(texts: Sequence[bytes], separators: bytes, lower: bool) -> Words:
    to, inside = byte_classes(separators, lower)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    buffer = to[raw] if lower else raw
    member = inside[raw]
    member[bounds[1:] - 1] = False
    edges = np.diff(member.astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _Powers.to(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    hashes = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(buffer, bounds, start, end, hashes, np.searchsorted(bounds, start, "right") - 1)


def chunks(texts: Iterable[bytes], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Cut a list of texts into runs of at most ``limit`` bytes; a longer text is a run of its own, and stays whole."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` hashes; the i-th is of those from i on."""
    out = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _ODD + hashes[k : len(out) + k]
    return mixed(out)
