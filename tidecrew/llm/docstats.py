"""Statistics of whole texts, computed for many texts at once: the counts of the quality rules and the features that
classifiers learn from."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecrew.llm.words import SPACES, Words, chunks, mixed, window_hashes, words_of

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words",
    "word_length",
    "symbol_ratio",
    "dup_line_ratio",
    "repeat_ratio",
    "upper_ratio",
    "digit_ratio",
    "punctuation_ratio",
    "wide_ratio",
    "distinct_ratio",
    "top_word_share",
    "exclamation_ratio",
    "bar_ratio",
    "words_per_line",
    "echo_ratio",
)


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeated_words(words: Words, n: int = REPEAT_WINDOW) -> np.ndarray:
    """Per text, the words inside a window of ``n`` words that the text has at least twice."""
    size = len(words.hash)
    if size < n:
        return np.zeros(len(words.bounds) - 1, dtype=np.int64)
    keys = window_hashes(words.hash, n) + mixed(words.text[: size - n + 1].astype(np.uint64))
    inside = words.text[: size - n + 1] == words.text[n - 1 :]
    at = np.flatnonzero(inside)
    order = at[np.argsort(keys[at], kind="stable")]
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    edges = np.zeros(size + 1, dtype=np.int64)
    edges[order[twice]] += 1
    np.subtract.at(edges, order[twice] + n, 1)
    return np.bincount(words.text[np.cumsum(edges[:-1]) > 0], minlength=len(words.bounds) - 1)


def _lines(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier one, per text."""
    total, repeated = [], []
    for text in texts:
        lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
        total.append(len(lines))
        repeated.append(len(lines) - len(set(lines)))
    return np.array(total, dtype=np.int64), np.array(repeated, dtype=np.int64)


def measured(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of the texts, a row for each; a text without words has zeros."""
    words = words_of(texts, SPACES, False)
    n, bounds, buffer = len(texts), words.bounds, words.buffer
    counts = words.counts
    points = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80, dtype=np.int64)])
    chars = np.bincount(words.text, weights=points[words.end] - points[words.start], minlength=n).astype(np.int64)
    kind = np.zeros(256, dtype=np.uint8)
    kind[list(SYMBOLS)] = 1
    classes = kind[buffer]
    symbols = _per_text(classes == 1, bounds)
    upper = _per_text((buffer >= 0x41) & (buffer <= 0x5A), bounds)
    digits = _per_text((buffer >= 0x30) & (buffer <= 0x39), bounds)
    marks = _per_text((buffer == 0x2E) | (buffer == 0x2C), bounds)
    wide = _per_text(buffer >= 0xC0, bounds)
    shouts = _per_text(buffer == 0x21, bounds)
    bars = _per_text(buffer == 0x7C, bounds)
    lines, repeated = _lines(texts)
    repeat = repeated_words(words)
    owner = np.zeros(n, dtype=np.int64)
    most = np.zeros(n, dtype=np.int64)
    if len(words.hash):
        order = np.lexsort((words.hash, words.text))
        text, value = words.text[order], words.hash[order]
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])])
        begin = np.flatnonzero(new)
        runs = np.diff(np.append(begin, len(order)))
        owner = np.bincount(text[begin], minlength=n)
        np.maximum.at(most, text[begin], runs)
    echo = np.zeros(n, dtype=np.int64)
    if len(words.hash) > 1:
        again = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
        echo = np.bincount(words.text[1:][again], minlength=n)
    w, c = np.maximum(counts, 1), np.maximum(chars, 1)
    features = np.stack(
        [
            np.log1p(counts),
            chars / w,
            symbols / w,
            repeated / np.maximum(lines, 1),
            repeat / w,
            upper / c,
            digits / c,
            marks / w,
            wide / c,
            owner / w,
            most / w,
            shouts / w,
            bars / w,
            counts / np.maximum(lines, 1),
            echo / w,
        ],
        axis=1,
    )
    return np.stack([counts, chars, symbols, repeated, repeat], axis=1).astype(np.int64), features


def texts_of(column: pa.Array) -> list[bytes]:
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def batches_measured(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Every batch with the counts and features of its texts, which are column ``at``."""
    for batch in batches:
        if batch.num_rows:
            done = [measured(part) for part in chunks(texts_of(batch.column(at)))]
            yield batch, np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def with_features(rows: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """The columns ``keep`` and an array ``features`` of every text."""
    kinds = [f"{name} {rows.schema[name].dataType.simpleString()}" for name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, features in batches_measured(batches, 0):
            columns = [*batch.columns[1:], pa.array(list(features), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "features"])

    return rows.select(F.col(text_col), *keep).mapInArrow(run, ", ".join([*kinds, "features array<double>"]))
