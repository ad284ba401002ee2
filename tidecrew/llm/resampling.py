"""Drawing documents like those of a target collection, by importance weights over hashed runs of words.

The words of a text, joined by one space, are scanned once for their running CRC-32.  The CRC of any run of words follows from
the one before its first word and the one after its last: a CRC is linear over GF(2), so what the first leaves after as
many bytes as the run has is taken off by exclusive or.  Runs go into buckets by their CRC.  The gain of a bucket compares its
smoothed share in the target with that in all documents; a document's weight is the mean gain of its runs.  Documents are drawn
without replacement by adding Gumbel noise, made from a hash of the id, to the weight and taking the highest.

Buckets are as many as the parameter says, so their counts, and the gains sent to the tasks, are of a proven size.

Defined cases: a NULL or empty text has no words and weight zero; a text shorter than a run has no run of that length; a NULL id
hashes like an empty one and comes last among equal scores; repeated rows each count and may each be drawn; an empty table
gives no rows; an empty target gives gains from the smoothing alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecrew.llm.docstats import texts_of
from tidecrew.llm.pieces import word_lists
from tidecrew.llm.tables import stored
from tidecrew.llm.words import NOT_ALPHANUMERIC, chunks
from tidecrew.plans.running import sorted_positions

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
# Runs whose CRC is derived at a time.
BATCH = 1 << 18
# The polynomial of CRC-32, lowest power first.
_POLYNOMIAL = np.uint32(0xEDB88320)


@lru_cache(maxsize=1)
def byte_steps() -> np.ndarray:
    """What one zero byte does to each value of a register's lowest byte."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = (steps >> np.uint32(1)) ^ np.where(steps & np.uint32(1), _POLYNOMIAL, np.uint32(0))
    return steps


@lru_cache(maxsize=64)
def _zeros(power: int) -> np.ndarray:
    """What 2 ** power zero bytes do to each value of each byte of a register: a row per byte."""
    values = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    if power == 0:
        after = byte_steps()[values & np.uint32(0xFF)] ^ (values >> np.uint32(8))
    else:
        after = _applied(_zeros(power - 1), _applied(_zeros(power - 1), values))
    return after.reshape(4, 256)


def _applied(table: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    out = table[0][crcs & np.uint32(0xFF)]
    for k in range(1, 4):
        out ^= table[k][(crcs >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What CRCs become after as many zero bytes: products by powers of x, a table per bit of the length."""
    out = crcs.copy()
    for power in range(int(lengths.max(initial=0)).bit_length()):
        some = np.flatnonzero(lengths >> power & 1)
        out[some] = _applied(_zeros(power), out[some])
    return out


class Scanned(NamedTuple):
    """Texts laid end to end: the CRC of a text up to the end of each word, the place of that end, and the words of each text."""

    crcs: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


def scanned(texts: Iterable[bytes]) -> Scanned:
    """The running CRCs of every text, whose words are joined by one space."""
    crc32, crcs, lengths, counts = zlib.crc32, [], [], []
    for text in texts:
        last = n = 0
        for words in word_lists(text, NOT_ALPHANUMERIC, True):
            if words:
                spaced = b"\n ".join(words).split(b"\n")
                if n:
                    spaced[0] = b" " + spaced[0]
                found = list(accumulate(spaced, lambda crc, word: crc32(word, crc), initial=last))
                last = found[-1]
                n += len(words)
                crcs.append(np.array(found[1:], dtype=np.uint32))
                lengths.append(np.fromiter(map(len, spaced), dtype=np.int64, count=len(spaced)))
        counts.append(n)
    counts = np.array(counts, dtype=np.int64)
    if not crcs:
        return Scanned(np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), counts)
    ends = np.cumsum(np.concatenate(lengths))
    return Scanned(np.concatenate(crcs), ends, counts)


def runs_of(scan: Scanned, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The CRC of every run of ``n`` words, from the CRCs before and after it, and how many runs each text has."""
    counts = np.maximum(scan.counts - n + 1, 0)
    skipped = np.repeat(np.cumsum(scan.counts) - scan.counts - (np.cumsum(counts) - counts), counts)
    heads = np.zeros(len(scan.crcs), dtype=bool)
    heads[(np.cumsum(scan.counts) - scan.counts)[scan.counts > 0]] = True
    out = np.empty(len(skipped), dtype=np.uint32)
    for at in range(0, len(out), BATCH):
        first = np.arange(at, min(at + BATCH, len(out))) + skipped[at : at + BATCH]
        inside, before = ~heads[first], np.maximum(first - 1, 0)
        start = np.where(first > 0, scan.ends[before], 0) + inside
        crcs = np.where(inside, _after_space(scan.crcs[before]), np.uint32(0))
        out[at : at + BATCH] = scan.crcs[first + n - 1] ^ shifted(crcs, scan.ends[first + n - 1] - start)
    return out, counts


def _after_space(crcs: np.ndarray) -> np.ndarray:
    """CRCs after one more space; the register is the complement of the CRC."""
    register = ~crcs
    return ~(byte_steps()[(register ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (register >> np.uint32(8)))


def with_buckets(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` (id, text) as (id, n_words, n_features, buckets): the bucket of every run of 1 to ``longest`` words."""
    kind = docs.schema["id"].dataType.simpleString()
    wide = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in chunks(texts_of(batch.column(1))):
                scan = scanned(texts)
                found = [runs_of(scan, n) for n in range(1, longest + 1)]
                counts = sum(f[1] for f in found)
                bounds = [np.concatenate([[0], np.cumsum(f[1])]).tolist() for f in found]
                codes = [(f[0] % np.uint32(buckets)).astype(wide) for f in found]
                runs = [b"".join(c[b[i] : b[i + 1]].tobytes() for c, b in zip(codes, bounds, strict=True)) for i in range(len(texts))]
                columns = [pa.array(scan.counts), pa.array(counts), pa.array(runs, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], ["id", "n_words", "n_features", "buckets"])
                at += len(texts)

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n_words long, n_features long, buckets binary")


def bucket_counts(runs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of ``runs`` (buckets) are in each bucket: added up per task, then per bucket."""
    wide = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer() or b"", dtype=wide), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counts = np.zeros(buckets, dtype=np.int64)
    for row in runs.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's smoothed share in the target over that in the source, floored."""
    buckets, all_target, all_source = len(target), int(target.sum()), int(source.sum())
    found = [
        math.floor(1000 * math.log(float(t + 1) * float(all_source + buckets) / (float(s + 1) * float(all_target + buckets))))
        for t, s in zip(target.tolist(), source.tolist(), strict=True)
    ]
    return np.array(found, dtype=np.int64)


def weighted(runs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of every document's runs."""
    kind = runs.schema["id"].dataType.simpleString()
    sent = runs.sparkSession.sparkContext.broadcast(gain)
    wide = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for value in batch.column(3):
                found = sent.value[np.frombuffer(value.as_buffer() or b"", dtype=wide)]
                weights.append(int(found.sum()) // len(found) if len(found) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], ["id", "n_words", "n_features", "weight"])

    return runs.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, floored, from a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296))).cast("long")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; the rank of those not drawn is NULL."""
    runs = stored(with_buckets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), longest, buckets), "runs")
    aims = with_buckets(target.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), longest, buckets)
    gain = gains(bucket_counts(aims, buckets), bucket_counts(runs, buckets))
    rows = stored(weighted(runs, gain).withColumn("score", F.col("weight") + noise("id", seed)), "weights")
    enough = rows.filter(F.col("n_words") >= least_words)
    drawn = enough.count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = sorted_positions(enough, [], order, "place").withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["id", "n_features", "weight", "score", "rank"]
    return placed.select(columns).unionByName(rest.select(columns)).withColumnRenamed("id", id_col)
