"""Two tables met block by block: every block of one with every block of the other, each pair of blocks a task of its own."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from tidecrew.plans.durable import cut


def blocks_for(rows: int, size: int, least: int, cores: int) -> int:
    """Blocks of at most about ``size`` rows; more of them, of at least ``least`` rows, while cores would be idle."""
    return max(1, -(-rows // size), min(-(-rows // least), 2 * cores))


def packed(rows: DataFrame, key: str, blocks: int, form: Callable[[pa.Table], Any]) -> DataFrame:
    """(size, block): a partition and a row for every block, which is what ``form`` makes of its rows, stored once.

    Rows of equal ``key`` are in one block.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        if sum(batch.num_rows for batch in own):
            plain = pickle.dumps(form(pa.Table.from_batches(own)), protocol=5)
            packet = pa.Codec("zstd").compress(plain, asbytes=True)
            yield pa.record_batch({"size": pa.array([len(plain)], pa.int64()), "block": pa.array([packet], pa.binary())})

    return cut(rows.repartition(blocks, key).mapInArrow(pack, "size long, block binary"))


def _unpacked(sizes: pa.Array, blocks: pa.Array, place: int) -> Any:
    return pickle.loads(pa.Codec("zstd").decompress(blocks[place].as_buffer(), sizes[place].as_py()))


def met(left: DataFrame, right: DataFrame, run: Callable[[Any, Any], pa.Table], schema: str) -> DataFrame:
    """``run`` on every block of ``left`` with every block of ``right``, both :func:`packed`.

    A task reads its two blocks from the shared folder, so no row is shuffled and nothing is stored a second time, however many
    blocks the other side has.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(batch.num_rows):
                one, two = (_unpacked(batch.column(c), batch.column(c + 1), place) for c in (0, 2))
                yield from run(one, two).to_batches()

    pairs = left.toDF("_size", "_block").hint("shuffle_replicate_nl").crossJoin(right)
    return pairs.mapInArrow(task, schema)
