"""Reading inputs and keeping intermediate tables where every executor can reach them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecrew.plans.durable import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back: the plan is cut, and a lost executor costs
    only the tasks it ran.  Such tables stay until the folder is cleared, as checkpoint files do."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def spread_evenly(df: DataFrame) -> DataFrame:
    """``df`` as it is when its files already give every core work, else dealt out round robin.

    A small table in one file would otherwise be worked on by a single task.  Row order and content do not change.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def row_key(id_col: str, text_col: str = "text") -> Column:
    """Tells documents apart and orders them: id (NULL last), then a hash of the text."""
    key = F.col(id_col)
    return F.struct(key.isNull().alias("no_id"), key.alias("id"), F.xxhash64(text_col).alias("text"))


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns as the struct ``row``, next to ``more``: names of the input cannot clash with those of the work."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def unpacked(rows: DataFrame, columns: list[str], **instead: Column) -> DataFrame:
    """The columns of the input again, some replaced."""
    return rows.select(*[(instead[c] if c in instead else F.col("row").getField(c)).alias(c) for c in columns])


def without(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose :func:`row_key` is not among ``keys`` (key)."""
    named = packed(docs, own=row_key(id_col, text_col))
    rest = named.join(keys.select(F.col("key").alias("gone")), F.col("own") == F.col("gone"), "left_anti")
    return unpacked(rest, docs.columns)
