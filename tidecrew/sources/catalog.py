"""The named datasets an operator reads, and where they come from."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = (
    "users",
    "drives",
    "drive_volunteers",
    "drive_feedback",
    "volunteer_badges",
    "donations",
    "products",
    "purchases",
    "product_feedback",
    "cart",
    "system_settings",
)


class Tables:
    """Datasets by name.  Each is built on first use, so an operator only opens the files it reads."""

    def __init__(self, spark: SparkSession, builders: Mapping[str, Callable[[], DataFrame]]):
        self.spark = spark
        self._builders = dict(builders)
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._builders:
            raise AttributeError(f"no table {name!r}; known: {sorted(self._builders)}")
        if name not in self._frames:
            self._frames[name] = self._builders[name]()
        return self._frames[name]

    def has(self, name: str) -> bool:
        return name in self._builders

    def with_tables(self, **frames: DataFrame) -> Tables:
        """The same datasets with some replaced by a newer version."""
        builders = dict(self._builders)
        builders.update({name: (lambda df=df: df) for name, df in frames.items()})
        return Tables(self.spark, builders)


def row_counts(tables: Tables, names: tuple[str, ...]) -> DataFrame:
    """Rows per dataset, as a load check."""
    counts = [
        getattr(tables, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        for name in names
    ]
    return reduce(DataFrame.unionByName, counts)


def parquet_catalog(spark: SparkSession, root: str, names: tuple[str, ...] = TABLE_NAMES) -> Tables:
    """Datasets stored as ``root/<name>`` parquet folders."""
    return Tables(spark, {n: (lambda n=n: spark.read.parquet(f"{root}/{n}")) for n in names})


def store_catalog(tables: Tables, root: str, names: tuple[str, ...] = TABLE_NAMES) -> None:
    """Write datasets to the layout :func:`parquet_catalog` reads."""
    for name in names:
        getattr(tables, name).write.mode("overwrite").parquet(f"{root}/{name}")


def store_bucketed(df: DataFrame, name: str, keys: Sequence[str], folder: str, buckets: int = 64) -> DataFrame:
    """Store ``df`` as the session's table ``name``, in buckets by ``keys`` and sorted within them.

    A join on those keys then shuffles only the other side.  With all keys of a pair a bucket cannot be hot, though one of
    the pair is: name a second column where the first one alone would be.
    """
    rows = df.repartition(buckets, *keys)
    rows.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", folder).saveAsTable(name)
    return df.sparkSession.table(name)


def jdbc_catalog(
    spark: SparkSession,
    url: str,
    properties: Mapping[str, str],
    split: Mapping[str, tuple[str, int, int, int]] | None = None,
    names: tuple[str, ...] = TABLE_NAMES,
) -> Tables:
    """Datasets in a relational database.

    ``split`` gives (column, lower, upper, partitions) per table; a table without it is read by a single task.
    """

    def read(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**properties)
        if split and name in split:
            column, lower, upper, parts = split[name]
            reader = (
                reader.option("partitionColumn", column)
                .option("lowerBound", lower)
                .option("upperBound", upper)
                .option("numPartitions", parts)
            )
        return reader.load()

    return Tables(spark, {n: (lambda n=n: read(n)) for n in names})
