"""Cutting long texts at separators, so that the objects made for words stay few."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from tidecrew.llm.words import byte_classes

PIECE = 1 << 20


@lru_cache(maxsize=8)
def _pattern(separators: bytes) -> re.Pattern[bytes]:
    return re.compile(b"[" + re.escape(separators) + b"]")


@lru_cache(maxsize=8)
def _to_spaces(separators: bytes, lower: bool) -> bytes:
    to, inside = byte_classes(separators, lower)
    to[~inside] = 0x20
    return to.tobytes()


def pieces(text: bytes, separators: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in pieces of ``size`` bytes and what is left of the last word; no word is cut."""
    at = 0
    while len(text) - at > size:
        found = _pattern(separators).search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def word_lists(text: bytes, separators: bytes, lower: bool, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece."""
    table = _to_spaces(separators, lower)
    for piece in pieces(text, separators, size):
        yield piece.translate(table).split()
