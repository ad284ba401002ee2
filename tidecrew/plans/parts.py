"""Tables stored in parts by ranges of a key, of which a change rewrites only those it touches."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecrew.plans.combine import broadcast_up_to
from tidecrew.plans.durable import cut

PART = "_part"
# Every part holds one row more, without a key, so that a part whose rows are all gone is still written anew.
REAL = "_real"
# Parts of a table at most; also of what a change touches, so the list of those is sent to the tasks.
PARTS = 1 << 14


class Parts(NamedTuple):
    """A stored table: rows of keys from ``width`` * n up to ``width`` * (n + 1) are part n."""

    spark: SparkSession
    folder: str
    key: str
    width: int
    schema: T.StructType

    def of(self, key: Column) -> Column:
        return F.floor(key / self.width).cast("long")

    def read(self, touched: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the parts in ``touched`` (``_part``): the other parts' files are not read."""
        fields = [*self.schema.fields, T.StructField(REAL, T.BooleanType()), T.StructField(PART, T.LongType())]
        rows = self.spark.read.schema(T.StructType(fields)).parquet(self.folder)
        if touched is not None:
            rows = rows.join(broadcast_up_to(touched, PARTS), PART, "left_semi")
        return rows.filter(REAL).drop(PART, REAL)

    def write(self, rows: DataFrame, touched: DataFrame) -> None:
        """Replace the parts in ``touched`` by ``rows``; the files of other parts stay as they are."""
        columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
        whole = rows.withColumns({REAL: F.lit(True), PART: self.of(F.col(self.key))}).unionByName(
            touched.select(*columns, F.lit(False).alias(REAL), PART)
        )
        # A part with very many rows is split over tasks at run time, small ones are put together.
        writer = whole.hint("rebalance", PART).write.mode("overwrite").partitionBy(PART)
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.folder)

    def change(self, keys: DataFrame, new_rows: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the parts that hold one of ``keys`` by what ``new_rows`` makes of their rows.

        ``new_rows`` must leave rows of other keys alone.  The parts are replaced when all their files are written, one after the
        other; a change that sets values can be repeated after a failure in between.
        """
        touched = cut(keys.select(self.of(F.col(keys.columns[0])).alias(PART)).na.drop().distinct())
        # Stored before the files it came from are replaced.
        self.write(cut(new_rows(self.read(touched))), touched)


def store_parts(rows: DataFrame, folder: str, key: str, parts: int = 64) -> Parts:
    """Store a table in about that many parts of equal ranges of a whole-numbered key; rows without a key are part NULL."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    width = 1 if low is None else max(1, -(-(high - low + 1) // min(parts, PARTS)))
    stored = Parts(rows.sparkSession, folder, key, width, rows.schema)
    stored.write(rows, rows.select(stored.of(F.col(key)).alias(PART)).distinct())
    return stored
