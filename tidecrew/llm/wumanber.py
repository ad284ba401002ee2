"""Benchmark decontamination: Wu-Manber search for many word windows at once.

Every run of ten consecutive words of a benchmark item is a test string (an item of fewer words is one test string).  For
test strings of one length a shift table over blocks of two words says how far the search may jump; where it says
zero, a bucket keyed by the last and first block gives the test strings to compare, and direct comparison of the words
confirms them.  The search runs over the numpy word arrays of many documents at once, as lanes that jump on their own.

Items are searched in blocks of a fixed number of words, so what is broadcast is bounded however large the benchmark
is; between blocks the hits are stored.  Nothing is shuffled.

Defined cases: NULL and empty texts have no words; an item without words is no test string; the hits of an item
without id count, but it cannot be listed; an item given twice counts once; windows do not span documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecrew.llm.tables import stored
from tidecrew.llm.words import NOT_ALPHANUMERIC, Words, chunks, mixed, words_of

WINDOW = 10
# Words of one block of items; a word takes at most some 100 bytes of tables.
BLOCK_WORDS = 400_000
LANE = 256
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Table(NamedTuple):
    """Test strings of one length."""

    length: int
    block: int  # words of a block
    shift: np.ndarray  # by hash bucket of a block
    mask: np.uint64
    bucket: np.ndarray  # sorted keys of (last block, first block)
    first: np.ndarray  # row range of a key in the test strings
    last: np.ndarray
    strings: np.ndarray  # word hashes, a row per test string
    texts: list[bytes]
    items: list[list[int]]  # positions in the list of item ids


def _block_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block that ends at each word; where there is none, of less."""
    if size == 1:
        return words
    before = np.concatenate([words[:1], words[:-1]]) if len(words) else words
    return mixed(before * _MULTIPLIER + words)


def _bucket(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    return mixed(last * _MULTIPLIER + first)


def build(items: list[tuple[int, bytes]]) -> list[Table]:
    """Tables for (position of the item id, text) pairs, one for each length of test string."""
    found: dict[int, dict[bytes, tuple[np.ndarray, set[int]]]] = {}
    for at, text in items:
        words = words_of([text], NOT_ALPHANUMERIC, True)
        n = len(words.start)
        length = min(WINDOW, n)
        for k in range(n - length + 1 if n else 0):
            name = b" ".join([words.bytes(w) for w in range(k, k + length)])
            found.setdefault(length, {}).setdefault(name, (words.hash[k : k + length], set()))[1].add(at)
    out = []
    for length, named in sorted(found.items()):
        block = min(2, length)
        rows = np.array([row for row, _ in named.values()], dtype=np.uint64).reshape(-1, length)
        ends = np.stack([_block_hash(row, block) for row in rows])
        mask = np.uint64((1 << max(16, int(len(rows) * length).bit_length() + 3)) - 1)
        shift = np.full(int(mask) + 1, length - block + 1, dtype=np.int64)
        for k in range(block - 1, length):
            np.minimum.at(shift, ends[:, k] & mask, length - 1 - k)
        keys = _bucket(ends[:, -1], ends[:, block - 1])
        order = np.argsort(keys, kind="stable")
        bucket, first = np.unique(keys[order], return_index=True)
        texts, owners = list(named), [sorted(owner) for _, owner in named.values()]
        out.append(
            Table(
                length,
                block,
                shift,
                mask,
                bucket,
                first,
                np.append(first[1:], len(order)),
                rows[order],
                [texts[k] for k in order],
                [owners[k] for k in order],
            )
        )
    return out


def search(words: Words, table: Table) -> Iterator[tuple[int, int]]:
    """(first word, test string) of every occurrence, by word position in the chunk."""
    n, length = len(words.hash), table.length
    if n < length:
        return
    ends = _block_hash(words.hash, table.block)
    starts = np.arange(length - 1, n, LANE)
    stops = np.append(starts[1:], n)
    hits = []
    while len(starts):
        step = table.shift[ends[starts] & table.mask]
        hits.append(starts[step == 0])
        starts = starts + np.maximum(step, 1)
        going = starts < stops
        starts, stops = starts[going], stops[going]
    ending = np.concatenate(hits)
    ending = ending[words.text[ending] == words.text[ending - length + 1]]
    keys = _bucket(ends[ending], ends[ending - length + table.block])
    place = np.searchsorted(table.bucket, keys)
    place[place == len(table.bucket)] = 0
    known = table.bucket[place] == keys
    ending, place = ending[known], place[known]
    sizes = table.last[place] - table.first[place]
    window = np.repeat(ending, sizes) - length + 1
    string = np.repeat(table.first[place], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    same = np.ones(len(window), dtype=bool)
    for k in range(length):
        same &= words.hash[window + k] == table.strings[string, k]
    for at, row in zip(window[same].tolist(), string[same].tolist(), strict=True):
        if b" ".join([words.bytes(w) for w in range(at, at + length)]) == table.texts[row]:
            yield at, row


def _searched(batches: Iterator[pa.RecordBatch], tables: list[Table], ids: list) -> Iterator[pa.RecordBatch]:
    """Add the hits of one block of items to rows of (id, text, hit words as bits, item ids)."""
    for batch in batches:
        texts = [text or b"" for text in batch.column(1).cast(pa.binary()).to_pylist()]
        at = 0
        for part in chunks(texts):
            rows = batch.slice(at, len(part))
            at += len(part)
            words = words_of(part, NOT_ALPHANUMERIC, True)
            counts = words.counts
            offsets = np.concatenate([[0], np.cumsum(counts)])
            covered = np.zeros(len(words.hash) + 1, dtype=np.int64)
            found: dict[int, set[int]] = {}
            for table in tables:
                for first, row in search(words, table):
                    covered[first] += 1
                    covered[first + table.length] -= 1
                    found.setdefault(int(words.text[first]), set()).update(table.items[row])
            hit = np.cumsum(covered[:-1]) > 0
            bits, lists = [], []
            for k, (old, listed) in enumerate(zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)):
                own = hit[offsets[k] : offsets[k + 1]]
                if old is not None:
                    own = own | np.unpackbits(np.frombuffer(old, np.uint8), count=len(own)).astype(bool)
                bits.append(np.packbits(own).tobytes() if own.any() else None)
                new = {str(ids[i]) for i in found.get(k, ()) if ids[i] is not None}
                lists.append(sorted(new.union(listed or ())))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(1),
                    pa.array(bits, pa.binary()),
                    pa.array(lists, pa.list_(pa.string())),
                    pa.array(counts.astype(np.int64)),
                ],
                ["id", "text", "bits", "items", "n_words"],
            )


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple]]:
    """The items in blocks of at most ``block_words`` words, one block at a time in the driver.

    A long item is cut into pieces that overlap by a window less one, so its windows stay whole.
    """
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
    size = max(WINDOW, block_words // 4)
    pieces = (
        benchmark.select(F.col(id_col).alias("id"), words.alias("words"))
        .filter(F.size("words") > 0)
        .select(
            "id",
            F.explode(
                F.transform(
                    F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("words") - WINDOW) / size).cast("int"))),
                    lambda k: F.slice("words", k * size + 1, size + WINDOW - 1),
                )
            ).alias("words"),
        )
        .select("id", F.size("words").alias("n"), F.array_join("words", " ").alias("text"))
    )
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-2 * total // block_words))
    if blocks == 1:
        yield [(row["id"], row["text"]) for row in pieces.collect()]
        return
    dealt = stored(pieces.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))), "benchmark-blocks")
    for k in range(blocks):
        yield [(row["id"], row["text"]) for row in dealt.filter(F.col("block") == k).collect()]


def contaminated_words(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(id, n_words, n_hit, hit_bits, items): the words inside any occurrence of a test string, as a bit per word,
    and the ids, as sorted strings, of the items that occur."""
    kind = docs.schema[id_col].dataType.simpleString()
    state = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.lit(None).cast("binary").alias("bits"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    blocks = item_blocks(benchmark, item_id_col, item_text_col, block_words)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        ids = list(dict.fromkeys(item for item, _ in block))
        places = {item: k for k, item in enumerate(ids)}
        tables = docs.sparkSession.sparkContext.broadcast(
            (build([(places[item], text.encode()) for item, text in block]), ids)
        )
        found = state.mapInArrow(
            lambda batches, tables=tables: _searched(batches, *tables.value),
            f"id {kind}, text string, bits binary, items array<string>, n_words long",
        )
        state = stored(found, "benchmark-hits").drop("n_words") if after is not None else found
        block = after
    n_hit = _bits_set(F.col("bits"))
    return state.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.col("bits").alias("hit_bits"), "items"
    )


def _bits_set(bits: F.Column) -> F.Column:
    """How many bits of a binary value are set."""
    digits = F.translate(F.hex(bits), "0", "")
    ones = [(1, "1248"), (2, "3569AC"), (3, "7BDE"), (4, "F")]
    counts = [F.lit(n) * (F.length(digits) - F.length(F.translate(digits, letters, ""))) for n, letters in ones]
    return F.coalesce(sum(counts[1:], counts[0]), F.lit(0)).cast("long")
