"""Writing results: appended tables and JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecrew.functions.text import date_text

# Folder column that tells the batches of a stored table apart.
BATCH = "append_batch"


def append_rows(df: DataFrame, path: str, batch: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append the accepted rows of a batch to a stored table.

    A batch has a folder of its own, so appending it again after a failure replaces its rows instead of repeating them.
    """
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/{BATCH}={batch}")


def appended_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches."""
    return spark.read.parquet(path).drop(BATCH)


def _plain(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.DecimalType):
        column = column.cast("double")
    elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        column = date_text(column)
    elif isinstance(field.dataType, T.DateType):
        column = F.date_format(column, "yyyy-MM-dd")
    elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
        column = column.cast("bigint")
    return column.alias(field.name)


def plain_types(df: DataFrame) -> DataFrame:
    """The exchange form of a result: decimals as numbers, dates as text, whole numbers of one width."""
    return df.select(*[_plain(field) for field in df.schema.fields])


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, NULL fields included, dates in ISO 8601."""
    iso = df.select(
        *[
            F.date_format(F.col(f.name), "yyyy-MM-dd'T'HH:mm:ss").alias(f.name)
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
            else _plain(f)
            for f in df.schema.fields
        ]
    )
    return iso.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def export_json(df: DataFrame, path: str) -> None:
    """Write :func:`json_rows` as text files."""
    json_rows(df).write.mode("overwrite").text(path)
